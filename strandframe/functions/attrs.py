"""Attributes in headers: ``<delim>key<valdelim>value``; by default ``key=value`` after a blank in desc."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "undefined"


@dataclass(frozen=True)
class AttrFormat:
    """With a blank as delimiter only desc is searched, where a key may stand first; with another one id, then desc."""

    delim: str = " "
    value_delim: str = "="

    @classmethod
    def parse(cls, spec: str) -> AttrFormat:
        m = re.fullmatch(r"(.+?)key(.+?)value", spec, re.S)
        if not m:
            raise ValueError(f"attribute format must be <delim>key<delim>value: {spec!r}")
        return cls(m.group(1), m.group(2))

    @property
    def blank(self) -> bool:
        return self.delim == " "

    def _key(self, name: str) -> str:
        if not name or self.value_delim in name or self.delim in name:
            raise ValueError(f"invalid attribute name: {name!r}")
        head = r"(?:^| )" if self.blank else re.escape(self.delim)
        return head + re.escape(name) + re.escape(self.value_delim)

    def _until(self) -> str:
        return "((?:(?!" + re.escape(self.delim) + ").)*)"

    def get(self, name: str, id: Column, desc: Column) -> Column:
        """The first value, null if there is none; the value ``undefined`` counts as none."""
        pattern = "(?s)" + self._key(name) + self._until()
        of = lambda text: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
        value = of(desc) if self.blank else F.coalesce(of(id), of(desc))
        return F.nullif(value, F.lit(MISSING))

    def present(self, name: str, id: Column, desc: Column) -> Column:
        pattern = "(?s)" + self._key(name)
        found = F.coalesce(desc.rlike(pattern), F.lit(False))
        return found if self.blank else found | F.coalesce(id.rlike(pattern), F.lit(False))

    def append(self, name: str, value: Column, id: Column, desc: Column) -> tuple[Column, Column]:
        """(id, desc) with the attribute at the end of desc; at the end of id if the delimiter isn't a blank. A null value reads undefined."""
        pair = F.concat(F.lit(name + self.value_delim), F.coalesce(value, F.lit(MISSING)))
        if self.blank:
            return id, F.when(desc.isNull() | (desc == ""), pair).otherwise(F.concat(desc, F.lit(" "), pair))
        return F.concat(id, F.lit(self.delim), pair), desc

    def _replace_first(self, text: Column, name: str, value: Column) -> Column:
        pattern = "(?s)^(.*?" + self._key(name) + ")" + self._until() + "(.*)$"
        return F.concat(F.regexp_extract(text, pattern, 1), value, F.regexp_extract(text, pattern, 3))

    def edit(self, name: str, value: Column, id: Column, desc: Column) -> tuple[Column, Column]:
        """(id, desc) with the first value replaced, or the attribute appended."""
        value = F.coalesce(value, F.lit(MISSING))
        pattern = "(?s)" + self._key(name)
        in_desc = F.coalesce(desc.rlike(pattern), F.lit(False))
        new_id, new_desc = self.append(name, value, id, desc)
        if self.blank:
            return id, F.when(in_desc, self._replace_first(desc, name, value)).otherwise(new_desc)
        in_id = id.rlike(pattern)
        return F.when(in_id, self._replace_first(id, name, value)).when(in_desc, id).otherwise(new_id), F.when(~in_id & in_desc, self._replace_first(desc, name, value)).otherwise(desc)

    def delete(self, names: list[str], id: Column, desc: Column) -> tuple[Column, Column]:
        """(id, desc) without the first occurrence of each attribute; a desc left empty is ''."""
        for name in names:
            if self.blank:
                # an attribute at the start goes with the blank after it, any other with the blank before it
                key = re.escape(name) + re.escape(self.value_delim)
                at_start = desc.rlike("^" + key)
                desc = F.when(at_start, F.regexp_replace(desc, "^" + key + "[^ ]* ?", "")).otherwise(F.regexp_replace(desc, "(?s)^((?:(?! " + key + ").)*) " + key + "[^ ]*", "$1"))
            else:
                one = "(?s)^((?:(?!" + self._key(name) + ").)*)" + self._key(name) + self._until()
                in_id = id.rlike(self._key(name))
                id, desc = F.when(in_id, F.regexp_replace(id, one, "$1")).otherwise(id), F.when(in_id, desc).otherwise(F.regexp_replace(desc, one, "$1"))
        return id, desc

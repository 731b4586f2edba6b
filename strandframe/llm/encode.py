"""Encoding of texts with a byte-level BPE vocabulary file.

Each Arrow batch is cut into words with array operations on its code points (the classes
letter, number, space and other decide all cuts), and the words are dictionary-encoded, so
that each distinct word is merged once per worker. The merges run in a DuckDB recursive
query: rows of token positions join the merge table, each word's leftmost pair of lowest
rank is contracted, and this repeats until no word has a pair left. Ids of words are then
gathered back in text order. Texts are never cut short; ids of null and empty texts are [].

A worker keeps at most ``CACHE_WORDS`` words. A round of the query contracts one pair of each word, so its time grows
with the square of a word's length; a word of more than ``LONG_WORD`` bytes is contracted by array
operations that take all of its pairs of lowest rank at once. The result is the same: a merge makes no pair of lower rank than its own.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files on every machine; never copied into this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CHUNK_CHARS, WORDS_AT_ONCE, CACHE_WORDS, LONG_WORD = 3_000_000, 40_000, 1_500_000, 512
SPACE, LETTER, NUMBER, OTHER = range(4)

#: Characters of white space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def char_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    table[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "L"]] = LETTER
    table[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "N"]] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def word_starts(cp: np.ndarray, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Mask of the first characters of words. ``text_starts``: mask of the first characters of texts."""
    n = len(cp)
    cls = classes[cp]
    starts = text_starts.copy()
    starts[1:] |= cls[1:] != cls[:-1]
    if n < 2:
        return starts
    run = starts.copy()
    # the last blank of a run before a word: a space joins the word, another blank stands alone
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~text_starts[1:])
    starts[last] = True
    starts[last[cp[last] == 32] + 1] = False
    # endings such as 's are words of their own where the apostrophe begins a word
    at = np.flatnonzero((cp[:-1] == 39) & starts[:-1] & run[1:] & ~text_starts[1:] & (cls[1:] == LETTER))
    if len(at):
        a = cp[at + 1]
        b = np.where(at + 2 < n, cp[np.minimum(at + 2, n - 1)], 0)
        b = np.where((at + 2 < n) & text_starts[np.minimum(at + 2, n - 1)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        starts[at[one | two] + 1] = False
        end = np.concatenate([at[one] + 2, at[two] + 3])
        starts[end[end < n]] = True
    return starts


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return [other.get(b) or chr(b) for b in range(256)]


MERGE = """
WITH RECURSIVE t(w, step, ids) AS (
  SELECT w, 0, ids FROM words
  UNION ALL
  SELECT w, step + 1, list_concat(list_append(ids[:p - 1], id), ids[p + 2:]) FROM (
    SELECT w, any_value(step) AS step, any_value(ids) AS ids, min(rank * 4096 + p) % 4096 AS p, arg_min(id, rank * 4096 + p) AS id
    FROM (SELECT w, step, ids, unnest(range(1, len(ids))) AS p FROM t WHERE len(ids) > 1) AS pairs
    JOIN merges ON merges.pair = ids[p]::BIGINT * 65536 + ids[p + 1]
    GROUP BY w))
SELECT w, arg_max(ids, step) AS ids FROM t GROUP BY w ORDER BY w
"""

DECODE = """
SELECT n, string_agg(piece, '' ORDER BY pos) AS letters
FROM (SELECT n, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM encoded) AS e JOIN vocab USING (id) GROUP BY n
"""


class Encoder:
    """Words to ids; one per Python worker and file."""

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import duckdb

        self.path = path
        with open(path) as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = byte_letters()
        self.byte_id = np.array([vocab[x] for x in letters], np.int32)
        pairs = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        self.by_pair = np.argsort(pairs)  # the ranks in the order of their pairs
        self.pairs, self.merged = pairs[self.by_pair], np.array([vocab[a + b] for a, b in merges], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        table = pa.table({"pair": pa.array([vocab[a] * 65536 + vocab[b] for a, b in merges], pa.int64()), "rank": pa.array(range(len(merges)), pa.int64()), "id": pa.array([vocab[a + b] for a, b in merges], pa.int32())})
        self.db.register("m", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m").fetchall()
        self.db.unregister("m")
        self.vocab = vocab
        self.classes = char_classes()
        self.reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def contract(self, word: bytes) -> np.ndarray:
        """Ids of a word of any length: each round merges the pairs of lowest rank, from the left where they overlap."""
        ids, none = self.byte_id[np.frombuffer(word, np.uint8)], len(self.pairs)
        while len(ids) > 1:
            pair = ids[:-1].astype(np.int64) << 16 | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), none - 1)
            rank = np.where(self.pairs[at] == pair, self.by_pair[at], none)
            least = int(rank.min())
            if least == none:
                break
            hit = np.flatnonzero(rank == least)
            # of pairs that follow one another (as in aaa) every second one
            run = np.concatenate([[True], np.diff(hit) > 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            ids = ids.copy()
            ids[hit] = self.merged[least]
            ids = np.delete(ids, hit + 1)
        return ids

    def learn(self, words: list[bytes]) -> None:
        """Merges words that aren't known yet."""
        short = [w for w in words if len(w) <= LONG_WORD]
        names, lens, ids = [], [], []
        for i in range(0, len(short), WORDS_AT_ONCE):
            part = short[i : i + WORDS_AT_ONCE]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in part])])
            first = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.byte_id[np.frombuffer(b"".join(part), np.uint8)], pa.int32()))
            self.db.register("words", pa.table({"w": pa.array(np.arange(len(part)), pa.int64()), "ids": first}))
            merged = self.db.sql(MERGE).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("words")
            names += part
            lens.append(np.diff(merged.offsets.to_numpy()))
            ids.append(merged.flatten().to_numpy())
        for w in words:
            if len(w) > LONG_WORD:
                names.append(w)
                ids.append(self.contract(w))
                lens.append([len(ids[-1])])
        if names:
            self._keep(names, np.concatenate(lens), np.concatenate(ids))

    def _keep(self, words: list[bytes], lens: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens.astype(np.int64)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, texts: list[str], want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """(offsets of each text's ids, ids)."""
        text = "".join(texts)
        n_chars = np.fromiter(map(len, texts), np.int64, len(texts))
        if not text:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.cumsum(n_chars) - n_chars
        text_starts = np.zeros(len(cp), bool)
        text_starts[first[n_chars > 0]] = True
        starts = np.flatnonzero(word_starts(cp, text_starts, self.classes))
        data = text.encode()
        if len(data) == len(cp):
            cuts = starts
        else:
            width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
            cuts = (np.cumsum(width, dtype=np.int64) - width)[starts]
        offsets = np.append(cuts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self.reset()
        known = self.known
        self.learn([w for w in distinct if w not in known])
        code = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        lens = self.lens[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        offsets = ends[np.searchsorted(starts, np.append(first, len(cp)))]
        if not want_ids:
            return offsets, None
        return offsets, self.ids[np.repeat(self.starts[code] - ends[:-1], lens) + np.arange(ends[-1])]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _encode(path: str, id_type: pa.DataType, want_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _chunks(texts):
                offsets, ids = coder.encode([t or "" for t in texts[i:j]], want_ids)
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())) if want_ids else pa.array(np.diff(offsets), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), out], names=["doc", "ids" if want_ids else "n_ids"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, ids) of each row, ids as array<int>; [] for a null and for an empty text. Other columns are left out."""
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_encode(path, pa.int64(), True), f"doc {df.schema[id_col].dataType.simpleString()}, ids array<int>").withColumnRenamed("doc", id_col)


def count_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, n_ids) of each row; 0 for a null and for an empty text."""
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_encode(path, pa.int64(), False), f"doc {df.schema[id_col].dataType.simpleString()}, n_ids bigint").withColumnRenamed("doc", id_col)


def decode(path: str, ids: list[list[int]]) -> list[str]:
    """Texts of ids, by an ordered aggregation; for round trips."""
    coder = Encoder.of(path)
    back = {x: b for b, x in enumerate(byte_letters())}
    coder.db.register("vocab", pa.table({"piece": list(coder.vocab), "id": pa.array(coder.vocab.values(), pa.int32())}))
    coder.db.register("encoded", pa.table({"n": pa.array(range(len(ids)), pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))}))
    out = [""] * len(ids)
    for n, letters in coder.db.sql(DECODE).fetchall():
        out[n] = bytes(back[x] for x in letters).decode()
    return out

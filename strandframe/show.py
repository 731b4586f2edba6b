"""Records for a terminal: a few rows, with letters, and qualities, in colors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions.sequence import QUALITY, is_type

#: Colors of letters and of other characters (256-color codes), by palette.
PALETTES = {
    "dna": {"A": 71, "C": 68, "G": 178, "T": 160, "U": 160},
    "grey": {"A": 250, "C": 246, "G": 242, "T": 238, "U": 238},
    "protein": {**dict.fromkeys("DE", 160), **dict.fromkeys("KR", 68), **dict.fromkeys("H", 104), **dict.fromkeys("ST", 208), **dict.fromkeys("NQ", 37), **dict.fromkeys("CM", 178), **dict.fromkeys("AGILPV", 245), **dict.fromkeys("FWY", 71)},
}
RESET = "\x1b[0m"
#: Background colors from poor to good qualities (256-color codes), one for each ten of score.
QUALITY_COLORS = (196, 208, 226, 118, 46)


def view(df: DataFrame, n: int = 20, width: int = 100, color: bool = True, palette: str | None = None, quality: str | None = None) -> str:
    """The first n records in input order.

    Letters are colored by ``palette``, which the letters tell where none is named; with ``quality`` (a format of
    scores) their background shows the qualities.
    """
    rows = df.orderBy("_ord").limit(n).collect()
    colors = PALETTES[palette or ("dna" if all(is_type(r["seq"]) for r in rows) else "protein")]
    zero = QUALITY[quality][2] if quality else 0
    out = []
    for r in rows:
        seq = r["seq"][:width]
        if color:
            qual = r["qual"][:width] if quality and r["qual"] else ""
            ground = [f"\x1b[48;5;{QUALITY_COLORS[min(max(ord(q) - zero, 0) // 10, len(QUALITY_COLORS) - 1)]}m" for q in qual] or [""] * len(seq)
            letter = lambda c: f"\x1b[38;5;{colors[c.upper()]}m{c}" if c.upper() in colors else f"{RESET}{c}"
            seq = "".join((letter(c) if not g else g + letter(c).replace(RESET, "")) for c, g in zip(seq, ground)) + RESET
        out.append(f"{r['id']:<20.20} {seq}{'...' if len(r['seq']) > width else ''}")
    return "\n".join(out)

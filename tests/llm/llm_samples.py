"""Sample texts and rows."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, id string, digest string, shard string, label int"
WORDS = "the of and then onward rivers carry stones past quiet mills while people count lanterns under old bridges near mossy walls every evening".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x // 65536 % len(WORDS)] + (str(x % 97) if x % 5 == 0 else ""))
        if k % 17 == 16:
            out[-1] += ".\n"
    return " ".join(out)


def doc(i, text, source="s1"):
    return i, text, "en", source, None if text is None else len(text), 5, 0.5, "x", "y", "z", 1

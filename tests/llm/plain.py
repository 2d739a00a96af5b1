"""Small helpers of these tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n: int, start: int = 0) -> str:
    return " ".join(f"w{start + i}" for i in range(n))


def split(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(UPPER) if lower else text or "")

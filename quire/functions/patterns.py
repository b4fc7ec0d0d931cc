"""Fixed character classes and the regular expressions built from them."""

from __future__ import annotations

import re
from functools import cache

# ---- fixed values: character classes of the text rules -------------------------------------------
WORD_RUN = r"[^\p{Z}\p{Cc}]+"
GAP = r"[ \n\r\x{00A0}]"
IDEOGRAPHS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}\x{3040}-\x{30FF}"
LETTERS = r"\p{L}\p{M}\p{N}\p{Pc}"
SPACES = r"\p{Z}\p{Cc}\p{Cf}"
# Neighbours that make a hit part of a longer word.
WORD_NEIGHBOUR = r"[0-9A-Z\[\\\]^_`a-z\x{FB01}-\x{FB05}]"
# Blocks whose characters form words together; a character outside them is a word of its own.
JOINED_BLOCKS = (
    (0x0000, 0x00FE), (0x0400, 0x04FF), (0x0500, 0x052F), (0x0600, 0x06FF), (0x2000, 0x206F),
    (0x2113, 0x2113), (0x2DE0, 0x2DFF), (0xA640, 0xA69F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF),
)
CURLY_APOSTROPHE = "’"
# --------------------------------------------------------------------------------------------------

WORD_CLASS = f"[{LETTERS}&&[^{IDEOGRAPHS}]]"
UNIT = (
    f"[{IDEOGRAPHS}]"
    rf"|{WORD_CLASS}(?:{WORD_CLASS}|['\x{{2019}}\x{{02BC}}](?={WORD_CLASS})|(?<=\p{{Nd}})[.,](?=\p{{Nd}}))*"
    f"|[^{LETTERS}{SPACES}]+"
)
SENTENCE_END = rf"(?:[.!?](?=[{SPACES}]|\z)|[\x{{3002}}\x{{FF01}}\x{{FF1F}}][\"')\x{{201D}}\x{{2019}}]*)"
COMPARE_TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\s]+"
# The same runs found in a whole line: no run reaches over what ends a word.
LINE_TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\p{Cc}]+"


def stands_alone(ch: str) -> bool:
    return not any(low <= ord(ch) <= high for low, high in JOINED_BLOCKS)


def query_words(query: str) -> list[str]:
    """The words of a search: cut at spaces, with every stand-alone character a word of its own."""
    stripped = query.lstrip(" ")
    if not stripped:
        return [query] if query else []
    words: list[str] = [""] if stripped != query else []
    for piece in re.split(" +", stripped):
        if not piece:
            words.append("")
            continue
        run = ""
        for ch in piece:
            if stands_alone(ch) and not (run and ch == CURLY_APOSTROPHE):
                if run:
                    words.append(run)
                words.append(ch)
                run = ""
            else:
                run += ch
        if run:
            words.append(run)
    return words


@cache
def _same_when_lowered() -> dict[str, str]:
    """Lower-case character -> every character that lower-cases to it, one to one."""
    groups: dict[str, str] = {}
    for code in range(0x10000):
        ch = chr(code)
        low = ch.lower()
        if len(low) == 1 and low != ch:
            groups[low] = groups.get(low, low) + ch
    return groups


def _literal(word: str, match_case: bool) -> str:
    out = []
    for ch in word:
        group = ch if match_case else _same_when_lowered().get(ch.lower(), ch.lower())
        if len(group) > 1:
            out.append("[" + "".join(f"\\x{{{ord(c):04X}}}" if ord(c) > 127 else c for c in group) + "]")
        elif ch.isascii() and ch.isalnum():
            out.append(group)
        else:
            out.append(f"\\x{{{ord(group):04X}}}")
    return "".join(out)


def _whole(word: str, literal: str) -> str:
    if len(word) == 1 and ord(word) > 0xFF:
        return literal
    return f"(?<!{WORD_NEIGHBOUR}){literal}(?!{WORD_NEIGHBOUR})"


def search_pattern(query: str, match_case: bool = False, whole_word: bool = False, consecutive: bool = False) -> str:
    """One regular expression whose group 1 is a hit.

    When the first word is found but the rest does not follow, the search goes on after that word: the
    second alternative consumes it, leaving group 1 empty.
    """
    words = query_words(query)
    if not words:
        raise ValueError("empty query")
    if query.strip(" ") == "":
        hit = first = _literal(query, True)
    else:
        lead, trail = words[0] == "", words[-1] == ""
        inner = [w for w in words if w]
        parts = [_literal(w, match_case) for w in inner]
        first = parts[0]
        if whole_word:
            parts = [_whole(w, p) for w, p in zip(inner, parts)]
        hit = parts[0]
        for left, right, part in zip(inner, inner[1:], parts[1:]):
            loose = stands_alone(left[-1]) or stands_alone(right[0])
            hit += GAP + ("*" if loose else "+") + part
        if lead:
            hit = rf"(?:{GAP}|\A){hit}"
        if trail:
            hit += GAP
    if consecutive:
        return f"(?=({hit}))"
    return f"({hit})" if hit == first else f"({hit})|{first}"

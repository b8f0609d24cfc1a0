"""Code-page swaps as substitutions: what a text may have been before a wrong decoding."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

#: Encodings that texts are written in, and those by which they are wrongly read.
TRUE_SINGLE = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "cp852", "mac-roman", "mac-cyrillic", "cp1254", "cp1253")
TRUE_PAIRED = ("shift_jis", "euc_jp")
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "cp852", "mac-roman", "mac-cyrillic", "iso8859-15", "cp1254")
LOST = "�"
#: A text may have been read wrongly so many times.
TIMES = 3


@lru_cache(maxsize=None)
def letters(code_page: str) -> tuple[str, ...]:
    """The character of each byte; bytes without one stand for the control character of their number."""
    return tuple(bytes([b]).decode(code_page, "replace").replace(LOST, chr(b)) for b in range(256))


@lru_cache(maxsize=None)
def byte_of(code_page: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(letters(code_page)) if b >= 0x80}


@lru_cache(maxsize=None)
def swaps() -> tuple[tuple[str, dict[int, str]], ...]:
    """(name, table for str.translate) of each single-byte swap; swaps with equal tables are given once."""
    out, seen = [], set()
    for wrong in READ_AS:
        for true in TRUE_SINGLE:
            table = {ord(c): letters(true)[b] for c, b in byte_of(wrong).items() if letters(true)[b] != c}
            key = tuple(sorted(table.items()))
            if table and key not in seen:
                seen.add(key)
                out.append((f"{true}>{wrong}", table))
    return tuple(out)


@lru_cache(maxsize=None)
def _utf8_pattern(wrong: str) -> re.Pattern[str]:
    """Whatever is a UTF-8 sequence in the bytes of the wrong code page."""
    chars = letters(wrong)
    span = lambda a, b: "[" + re.escape("".join(chars[a : b + 1])) + "]"
    tail = span(0x80, 0xBF)
    return re.compile(f"{span(0xC2, 0xDF)}{tail}|{span(0xE0, 0xEF)}{tail}{{2}}|{span(0xF0, 0xF4)}{tail}{{3}}")


@lru_cache(maxsize=None)
def _roles() -> dict[str, tuple[int, int]]:
    """Of each character: the code pages (as bits) in whose bytes it begins a UTF-8 sequence, and those in which it goes on with one."""
    out: dict[str, tuple[int, int]] = {}
    for k, wrong in enumerate(READ_AS):
        for c, b in byte_of(wrong).items():
            lead, tail = out.get(c, (0, 0))
            out[c] = (lead | (0xC2 <= b <= 0xF4) << k, tail | (b <= 0xBF) << k)
    return out


def utf8_pages(text: str) -> list[str]:
    """The code pages in whose bytes two neighbouring characters may be part of a UTF-8 sequence."""
    roles, hit, before = _roles(), 0, 0
    for c in text:
        lead, tail = roles.get(c, (0, 0))
        hit |= before & tail
        before = lead
    return [wrong for k, wrong in enumerate(READ_AS) if hit >> k & 1] if hit else []


@lru_cache(maxsize=None)
def _sequences(wrong: str) -> dict[str, str]:
    """What unread_utf8 made of sequences of this code page so far."""
    return {}


def unread_utf8(text: str, wrong: str) -> str:
    """text with each sequence that is UTF-8 in the bytes of the wrong code page turned back into its character."""
    table, known = byte_of(wrong), _sequences(wrong)

    def back(m: re.Match[str]) -> str:
        out = known.get(m[0])
        if out is None:
            try:
                out = bytes(table[c] for c in m[0]).decode("utf-8")
            except UnicodeDecodeError:
                out = m[0]
            if len(known) < 1 << 16:
                known[m[0]] = out
        return out

    return _utf8_pattern(wrong).sub(back, text)


#: -log of the share of all runs of so many characters of a code page that are a UTF-8 sequence in its bytes.
FORM = {2: -math.log(30 * 64 / 128**2), 3: -math.log(16 * 64**2 / 128**3), 4: -math.log(5 * 64**3 / 128**4)}


def form(text: str, swap: str) -> float:
    """What the form of UTF-8 alone says for this swap: 0 unless all characters above ASCII are part of sequences, each of which
    no word would hold (one with a symbol in it) and which stands for an assigned character."""
    out = 0.0
    for step in swap.split("+"):
        wrong = step.split(">")[1]
        rest = text
        for m in _utf8_pattern(wrong).finditer(text):
            back = unread_utf8(m[0], wrong)
            if back == m[0] or unicodedata.category(back) in ("Cc", "Cn", "Co") or m[0].isalpha():
                return 0.0
            rest = rest.replace(m[0], "")
            out += FORM[len(m[0])]
        if not rest.isascii():
            return 0.0
        text = unread_utf8(text, wrong)
    return out


def unread_paired(text: str, true: str, wrong: str) -> str | None:
    """The whole text read again in a double-byte encoding; None where its bytes aren't that."""
    table = byte_of(wrong)
    try:
        return bytes(b if (b := table.get(c)) is not None else ord(c) for c in text).decode(true)
    except (UnicodeDecodeError, ValueError):
        return None


@lru_cache(maxsize=1 << 16)
def _by_swap(mark: str) -> str:
    """What each of swaps() makes of the character, one after the other."""
    return "".join(table.get(ord(mark), mark) for _, table in swaps())


@lru_cache(maxsize=1 << 16)
def substitutions(marks: str, known: frozenset[str] | None = None) -> tuple[tuple[str, str], ...]:
    """What the single-byte swaps make of these characters: (a swap, their letters), equal results once, known letters only."""
    made = list(zip(*map(_by_swap, marks), strict=True))
    first = dict(zip(reversed(made), range(len(made) - 1, -1, -1), strict=True))
    own = tuple(marks)
    return tuple((swaps()[k][0], "".join(to)) for to, k in sorted(first.items(), key=lambda x: x[1]) if to != own and (known is None or known.issuperset(to)))


def undo(text: str, swap: str) -> str:
    """text before the swap, which `earlier` named."""
    for step in swap.split("+"):
        true, wrong = step.split(">")
        if true == "utf-8":
            text = unread_utf8(text, wrong)
        elif true in TRUE_PAIRED:
            text = unread_paired(text, true, wrong) or text
        else:
            text = text.translate(dict(swaps())[step])
    return text


#: Up to so many different characters above ASCII, each may have been swapped alone as likely as all.
FEW = 4


def alone(text: str, odd: str, known: frozenset[str] | None = None) -> dict[str, str]:
    """What the text may have been before one of the odd characters was swapped alone, and the swap."""
    found: dict[str, str] = {}
    for c in odd:
        for name, x in substitutions(c, known):
            found.setdefault(text.replace(c, x), name)
    return found


def earlier(text: str, known: frozenset[str] | None = None, beside: Callable[[str, str], bool] | None = None) -> dict[str, str]:
    """What the text may have been before a wrong decoding in which ASCII stood for itself, and the swap that led to the text.

    known: characters that texts are made of; results of single-byte swaps with another one are left out, and those of whose
    first and last characters beside() says no. UTF-8 has a form that tells, so its results are kept.
    """
    found: dict[str, str] = {}
    level = {text: ""}
    for _ in range(TIMES):
        following: dict[str, str] = {}
        for t, how in level.items():
            for wrong in utf8_pages(t):
                if (before := unread_utf8(t, wrong)) != t and before not in found:
                    following.setdefault(before, f"{how}+utf-8>{wrong}".strip("+"))
        found |= following
        level = following
    marks = "".join(sorted({c for c in text if c >= "\x80"}))
    first, last = text[:1], text[-1:]
    for name, to in substitutions(marks, known):
        of = dict(zip(marks, to, strict=True))
        if beside is None or beside(of.get(first, first), of.get(last, last)):
            found.setdefault(text.translate(str.maketrans(of)), name)
    if 1 < len(marks) <= FEW:  # one of its characters may have been swapped alone; for more see `alone`
        for c in marks:
            for name, x in substitutions(c, known):
                if beside is None or beside(x if first == c else first, x if last == c else last):
                    found.setdefault(text.replace(c, x), name)
    return found


def earlier_paired(text: str) -> dict[str, str]:
    """The same for double-byte encodings, in whose characters ASCII may be the second byte: the whole text is read again."""
    found: dict[str, str] = {}
    for wrong in ("cp1252", "latin-1"):
        if not all(c < "\x80" or c in byte_of(wrong) for c in text):
            continue
        for true in TRUE_PAIRED:
            before = unread_paired(text, true, wrong)
            if before is not None and before != text:
                found.setdefault(before, f"{true}>{wrong}")
    return found

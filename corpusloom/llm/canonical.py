"""Canonical form of Python source: the word sequence with every order that does not count put straight.

A word is a longest run of ``a-z``, ``0-9`` and ``_`` in the lower-cased text.  Three orders do not count:
the keyword arguments of one call, the entries of one dictionary literal and the import lines.  Each of these
is sorted *within the places it already holds*, so two sources get the same canonical form exactly if one can be
turned into the other by such permutations and by changes to what lies between words.

The scan is lexical (one regular expression, one stack of brackets), so damaged code has a canonical form too: a
bracket that is never closed is treated as if it were not there.
"""

from __future__ import annotations

import re

#: Brackets nested deeper than the language allows do not count.
DEPTH = 200

_SPACE = r"[ \t\x0b\x0c\xa0]"
_TOKEN = re.compile(
    rf"""
    (?P<skip>\#[^\n\r]*|"{{3}}[\s\S]*?"{{3}}|'{{3}}[\s\S]*?'{{3}}|"(?:[^"\\\n\r]|\\[\s\S])*"|'(?:[^'\\\n\r]|\\[\s\S])*')
  | (?P<imp>(?:(?<=[\n\r])|\A|(?<=;)){_SPACE}*(?:import\b|from{_SPACE}+[\w.]+{_SPACE}+import\b)(?:[^\n\r\\\#(;]|\\\r?\n|\([^()]*\))*(?:;?{_SPACE}*\#[^\n\r]*)?)
  | (?P<kw>[a-z0-9_]+(?=\s*=(?!=)))
  | (?P<w>[a-z0-9_]+)
  | (?P<p>[()\[\]{{}},:])
    """,
    re.X,
)
_WORD = re.compile(r"[a-z0-9_]+")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def words(text: str | None) -> list[str]:
    """The words of *text*, in order; none for null."""
    return _WORD.findall(text.lower()) if text else []


class _Frame:
    """An open bracket: its finished parts, the part being read, and what is known of that part."""

    __slots__ = ("kind", "call", "parts", "flags", "cur", "flag", "lambdas", "comp")

    def __init__(self, kind: str, call: bool):
        self.kind, self.call = kind, call
        self.parts: list[list[str]] = []
        self.flags: list[bool] = []
        self.cur: list[str] = []
        self.flag = False
        self.lambdas = 0
        self.comp = False

    def cut(self) -> None:
        if self.cur:
            self.parts.append(self.cur)
            self.flags.append(self.flag)
            self.cur = []
        self.flag = False

    def flat(self) -> list[str]:
        """Words of the closed bracket, the free parts sorted into the places they hold."""
        if not self.parts:
            return self.cur
        self.cut()
        parts = self.parts
        if self.kind == "{":
            if any(self.flags) and not self.comp:
                parts = sorted(parts)
        elif self.call and sum(self.flags) > 1:
            free = iter(sorted(p for p, f in zip(parts, self.flags) if f))
            parts = [next(free) if f else p for p, f in zip(parts, self.flags)]
        return [w for p in parts for w in p]

    def raw(self) -> list[str]:
        """Words as they stand, for a bracket that is never closed."""
        return [w for p in self.parts for w in p] + self.cur


def canonical_words(text: str | None) -> list[str]:
    """The canonical word sequence of *text*; empty for null and for text without words."""
    if not text:
        return []
    text = text.lower()
    base = _Frame("", False)
    top, stack = base, []
    imports: list[tuple[list[str], int, list[str]]] = []
    deep = 0  # brackets beyond DEPTH that are open and do not count
    before = last = ""  # the last two words or closing brackets, to tell a call from a header
    for m in _TOKEN.finditer(text):
        kind, tok = m.lastgroup, m[0]
        if kind == "w":
            if top.kind:
                if tok == "lambda":
                    top.lambdas += 1
                elif tok == "for" and top.kind == "{":
                    top.comp = True
            top.cur.append(tok)
            before, last = last, tok
        elif kind == "kw":
            if not top.cur and top.call:
                top.flag = True
            top.cur.append(tok)
            before, last = last, tok
        elif kind == "p":
            if tok == ",":
                if top.kind and not top.lambdas:
                    top.cut()
            elif tok == ":":
                if top.lambdas:
                    top.lambdas -= 1
                elif top.kind == "{":
                    top.flag = True
            elif deep or (len(stack) >= DEPTH and tok in "([{"):
                deep += 1 if tok in "([{" else -1
            elif tok in "([{":
                stack.append(top)
                top = _Frame(tok, tok == "(" and bool(last) and before not in ("def", "class"))
                before = last = ""
            else:
                want = _CLOSES[tok]
                if top.kind != want and any(f.kind == want for f in stack):
                    while top.kind != want:  # openers that were never closed
                        lost, top = top, stack.pop()
                        top.cur += lost.raw()
                if top.kind == want:
                    done, top = top, stack.pop()
                    top.cur += done.flat()
                before, last = "", tok
            if tok in ",:":
                before = last = ""
        elif kind == "imp" and not top.kind:
            line = _WORD.findall(tok)
            imports.append((top.cur, len(top.cur), line))
            before = last = ""
        else:
            top.cur += _WORD.findall(tok)
            if kind == "skip" and tok[0] != "#":
                before = last = ""
    while stack:
        lost, top = top, stack.pop()
        top.cur += lost.raw()
    if not imports:
        return base.cur
    out, at = [], 0
    for (_, place, _), line in zip(imports, sorted(line for _, _, line in imports)):
        out += base.cur[at:place]
        out += line
        at = place
    return out + base.cur[at:]

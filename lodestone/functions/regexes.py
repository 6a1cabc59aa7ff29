"""Patterns of the query language, translated for Java's and Python's engines.

The language: Unicode classes and case folding, `.` matches all but line feed, `$` the very end of the text (of
a line under (?m)), no look-around and no back-references. What has no equal in the target is refused, so that
a pattern never silently means something else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\u200C\u200D"
SPACE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_POSIX = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\t-\r ", "blank": r" \t", "punct": r"!-/:-@\[-`{-~", "word": r"\w", "xdigit": "0-9A-Fa-f", "cntrl": r"\x00-\x1F\x7F", "graph": "!-~", "print": " -~", "ascii": r"\x00-\x7F"}
_POSIX["word"] = "A-Za-z0-9_"


class PatternError(ValueError):
    pass


def quote(literal: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", literal, flags=re.ASCII) if literal.isascii() else "".join(quote(c) if c.isascii() else c for c in literal)


@dataclass
class _Reader:
    text: str
    java: bool
    at: int = 0
    groups: int = 0

    def fail(self, what: str):
        raise PatternError(f"invalid regex: {what} at {self.at} in {self.text!r}")

    def escape(self, inside: bool) -> str:
        self.at += 1
        if self.at >= len(self.text):
            self.fail("lone backslash")
        c = self.text[self.at]
        self.at += 1
        if c in "dD":
            return r"\p{Nd}" if c == "d" else r"\P{Nd}"
        if c in "wWsS":
            own = WORD if c in "wW" else SPACE
            if inside and c.isupper():
                return f"[^{own}]"
            return own if inside else f"[{'^' if c.isupper() else ''}{own}]"
        if c in "bB" and not inside:
            w = f"[{WORD}]"
            return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))" if c == "b" else f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
        if c == "A" and not inside:
            return r"\A"
        if c == "z" and not inside:
            return r"\z" if self.java else r"\Z"
        if c in "pP":
            return "\\" + c + "{" + self.category() + "}"
        if c in "xuU":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{%d})" % {"x": 2, "u": 4, "U": 8}[c]).match(self.text, self.at)
            if not m:
                self.fail("bad code point")
            self.at = m.end()
            return self.char(chr(int(m[1] or m[2], 16)))
        if c in "ntrfva":
            return {"n": r"\n", "t": r"\t", "r": r"\r", "f": r"\f", "v": r"\x0B", "a": r"\x07"}[c]
        if c.isalnum():
            self.fail(f"\\{c} is not supported")
        return self.char(c)

    def char(self, c: str) -> str:
        return "\\" + c if c.isascii() and not c.isalnum() and c not in "\n\t\r" else c

    def category(self) -> str:
        if self.text[self.at : self.at + 1] != "{":
            self.at += 1
            return self.text[self.at - 1]
        end = self.text.find("}", self.at)
        if end < 0:
            self.fail("unclosed class")
        name = self.text[self.at + 1 : end]
        self.at = end + 1
        if name.startswith("^") or "=" in name:
            self.fail("this class is not supported")
        known = {"Letter": "L", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll", "Number": "N", "Punctuation": "P", "Symbol": "S", "Mark": "M", "Separator": "Z"}
        name = known.get(name, name)
        return name if len(name) <= 2 or not self.java else "Is" + name

    def klass(self) -> str:
        self.at += 1
        out = "["
        if self.text[self.at : self.at + 1] == "^":
            out, self.at = "[^", self.at + 1
        first = True
        while True:
            if self.at >= len(self.text):
                self.fail("unclosed bracket")
            c = self.text[self.at]
            if c == "]" and not first:
                self.at += 1
                return out + "]"
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at):
                if m[2] not in _POSIX:
                    self.fail("unknown class")
                out += f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]]
                self.at = m.end()
            elif c == "[":
                out += self.klass()
            elif self.text.startswith("&&", self.at):
                out, self.at = out + "&&", self.at + 2
            elif self.text.startswith("--", self.at) and not first and self.text[self.at + 2 : self.at + 3] == "[":
                self.at += 2
                inner = self.klass()
                out += ("&&" if self.java else "--") + ("[^" + inner[1:] if self.java and not inner.startswith("[^") else "[" + inner[2:] if self.java else inner)
            elif self.text.startswith("~~", self.at):
                self.fail("~~ is not supported")
            elif c == "\\":
                out += self.escape(True)
            else:
                out += c if c in "-" or c.isalnum() or not c.isascii() else "\\" + c if not c.isspace() else c
                self.at += 1
            first = False

    def flags(self, text: str) -> str:
        on, _, off = text.partition("-")
        for f in on + off:
            if f not in "imsxu":
                self.fail(f"flag {f} is not supported")
        if "u" in off:
            self.fail("flag -u is not supported")
        both = lambda x: "".join(("iu" if self.java else "i") if f == "i" else "" if f == "u" else f for f in x)
        return both(on) + ("-" + both(off) if off else "")

    def translate(self) -> str:
        out, stack, multi, verbose, atom = [], [], False, False, 0  # atom: where what a repetition repeats begins in out
        repeated = True  # what precedes can't be repeated
        while self.at < len(self.text):
            c = self.text[self.at]
            if c not in ")*+?{":
                atom = len(out)
            if c == "\\":
                out.append(self.escape(False))
            elif c == "[":
                out.append(self.klass())
            elif c == "(":
                stack.append((multi, verbose, atom))
                m = re.compile(r"\((?:\?(?:P?<(\w+)>|([imsxuUR-]*)([:)])|(.)))?").match(self.text, self.at)
                self.at = m.end()
                if m[4]:
                    self.fail("look-around and atomic groups are not supported")
                if m[2] is not None:
                    flags = self.flags(m[2])
                    on, _, off = m[2].partition("-")
                    if m[3] == ")":
                        stack.pop()
                    multi = ("m" in on or multi) and "m" not in off
                    verbose = ("x" in on or verbose) and "x" not in off
                    out.append(f"(?{flags}{m[3]}" if flags or m[3] == ":" else "")
                    if "m" in on and self.java:
                        pass
                elif m[1]:
                    self.groups += 1
                    out.append(f"(?<g{self.groups}>" if self.java else f"(?P<g{self.groups}>")
                else:
                    out.append("(")
                repeated = True
                continue
            elif c == ")":
                if not stack:
                    self.fail("unopened group")
                multi, verbose, atom = stack.pop()
                out.append(")")
                self.at += 1
            elif c in "^$":
                if c == "^":
                    out.append(r"(?:\A|(?<=\n))" if multi else r"\A")
                else:
                    out.append(r"(?=\n|\z)" if multi and self.java else r"(?=\n|\Z)" if multi else r"\z" if self.java else r"\Z")
                self.at += 1
            elif c in "*+?" or (c == "{" and re.compile(r"\{\d+(,\d*)?\}").match(self.text, self.at)):
                if repeated:
                    self.fail("repetition without an expression")
                repetition = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??")
                m = repetition.match(self.text, self.at)
                out.append(m[0])
                self.at = m.end()
                if repetition.match(self.text, self.at):
                    # a repetition of a repetition; both engines would read the pair as a mode of the first
                    out[atom:] = ["(?:", *out[atom:], ")"]
                continue
            elif c == "{":
                self.fail("unclosed repetition")
            elif verbose and c == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
                continue
            else:
                out.append(c)
                self.at += 1
                repeated = c == "|"
                continue
            repeated = False
        if stack:
            self.fail("unclosed group")
        return "".join(out)


def java(pattern: str, case_sensitive: bool = False) -> str:
    """For rlike and the regexp functions: `.` excludes line feed alone, case is Unicode's."""
    return ("(?d)" if case_sensitive else "(?diu)") + _Reader(pattern, True).translate()


def python(pattern: str, case_sensitive: bool = False) -> str:
    """For the regex module, version 1."""
    return "(?V1)" + ("" if case_sensitive else "(?i)") + _Reader(pattern, False).translate()

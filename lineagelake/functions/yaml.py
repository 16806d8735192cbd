"""The part of YAML that configuration files use, read into plain Python values.

Block mappings and sequences, flow ones, quoted and block scalars, comments and several documents. Scalars stay text, nulls become the word
``null``. An alias stands for the value of its anchor, the last before it in its document; tags are passed over. An unknown alias and keys that are no
scalars raise ``ValueError``, as does what doesn't fit together.
"""

from __future__ import annotations

import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},&*!|>'"%@`#-][^#]*?|-[^\s][^#]*?)\s*:(?:\s+(.*))?$""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "/": "/", "r": "\r", "0": "\0"}


def _properties(text: str) -> tuple[str | None, str]:
    """The anchor before a value, if any, and the value without anchor and tag."""
    anchor = None
    while text[:1] in ("&", "!"):
        head, _, rest = text.partition(" ")
        anchor, text = head[1:] if head[0] == "&" else anchor, rest.lstrip()
    return anchor, text


def scalar(text: str, anchors: dict | None = None):
    anchor, text = _properties(text)
    if text[:1] == "*" and anchors is not None and text[1:] in anchors:
        return anchors[text[1:]]
    if text[:1] in ("*", "%", "@", "`"):
        raise ValueError(f"not read: {text}")
    if len(text) > 1 and text[0] == text[-1] == "'":
        out = text[1:-1].replace("''", "'")
    elif len(text) > 1 and text[0] == text[-1] == '"':
        out = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1])
    else:
        out = "null" if text in ("", "~", "null", "Null", "NULL") else text
    if anchor is not None and anchors is not None:
        anchors[anchor] = out
    return out


def _flow(text: str, at: int, anchors: dict):
    """The flow value at a place and where it ends."""
    named = re.compile(r"((?:[&!][^\s\[\]{},]*\s+)+)(?=[\[{])").match(text, at)
    if named:
        value, end = _flow(text, named.end(), anchors)
        anchor = _properties(named[1])[0]
        if anchor is not None:
            anchors[anchor] = value
        return value, end
    if text[at] in "[{":
        close, out, pairs = ("]", [], False) if text[at] == "[" else ("}", {}, True)
        at += 1
        while True:
            while text[at] in " ,\n":
                at += 1
            if text[at] == close:
                return out, at + 1
            value, at = _flow(text, at, anchors)
            while text[at] == " ":
                at += 1
            if pairs:
                if not isinstance(value, str):
                    raise ValueError("a key that is no scalar")
                inner, at = ("null", at) if text[at] in ",}" else _flow(text, at + 1 + len(text[at + 1 :]) - len(text[at + 1 :].lstrip()), anchors)
                out[value] = inner
            else:
                out.append(value)
    m = re.compile(r""" *("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^,:\[\]{}]|:(?=\S))*)""").match(text, at)
    return scalar(m[1].strip(), anchors), m.end()


def _value(text: str, anchors: dict):
    anchor, bare = _properties(text)
    if bare[:1] in ("[", "{"):
        try:
            value, end = _flow(bare, 0, anchors)
        except IndexError:
            raise ValueError(f"not closed: {text}") from None
        if bare[end:].strip():
            raise ValueError(f"not read: {text}")
        if anchor is not None:
            anchors[anchor] = value
        return value
    return scalar(text, anchors)


def _plain(line: str) -> str:
    """A line without its comment."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and (k == 0 or line[k - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


class _Lines:
    def __init__(self, raw: list[str]):
        self.raw = raw
        self.rows = [(k, len(p) - len(p.lstrip(" ")), p.strip()) for k, p in enumerate(map(_plain, raw)) if p.strip()]
        self.at = 0
        self.anchors: dict = {}

    def named(self, anchor: str | None, value):
        if anchor is not None:
            self.anchors[anchor] = value
        return value

    def block(self, indent: int):
        _, own, text = self.rows[self.at]
        if own < indent:
            return "null"
        if text == "-" or text.startswith("- "):
            return self.sequence(own)
        if _KEY.match(text):
            return self.mapping(own)
        self.at += 1
        anchor, bare = _properties(text)
        if anchor is not None and not bare and self.at < len(self.rows):
            return self.named(anchor, self.block(own))
        return _value(text, self.anchors)

    def sequence(self, indent: int) -> list:
        out = []
        while self.at < len(self.rows) and self.rows[self.at][1] == indent and (self.rows[self.at][2] == "-" or self.rows[self.at][2].startswith("- ")):
            k, _, text = self.rows[self.at]
            anchor, rest = _properties(text[1:].lstrip())
            if rest:
                self.rows[self.at] = (k, indent + len(text) - len(rest), rest)
                out.append(self.named(anchor, self.block(indent + 1)))
            else:
                self.at += 1
                out.append(self.named(anchor, self.block(indent + 1) if self.at < len(self.rows) else "null"))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while self.at < len(self.rows) and self.rows[self.at][1] == indent and (m := _KEY.match(self.rows[self.at][2])):
            k, key, (anchor, rest) = self.rows[self.at][0], scalar(m[1]), _properties(m[2] or "")
            self.at += 1
            below = self.at < len(self.rows) and (self.rows[self.at][1] > indent or (self.rows[self.at][1] == indent and self.rows[self.at][2].startswith("-") and self.rows[self.at][2][1:2] in (" ", "")))
            if re.fullmatch(r"[|>][+-]?\d*", rest):
                out[key] = self.named(anchor, self.text(k, indent, rest))
            elif rest:
                out[key] = self.named(anchor, _value(rest, self.anchors))
            else:
                out[key] = self.named(anchor, self.block(indent) if below else "null")
        if self.at < len(self.rows) and self.rows[self.at][1] > indent:
            raise ValueError(f"too far in: {self.rows[self.at][2]}")
        return out

    def text(self, k: int, indent: int, style: str) -> str:
        """A block scalar: the raw lines that are further in."""
        lines = []
        for line in self.raw[k + 1 :]:
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            lines.append(line)
        end = k + 1 + len(lines)
        while self.at < len(self.rows) and self.rows[self.at][0] < end:
            self.at += 1
        while lines and not lines[-1].strip():
            lines.pop()
        cut = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
        body = ("\n" if style[0] == "|" else " ").join(x[cut:] for x in lines)
        return body if "-" in style or not lines else body + "\n"


def documents(text: str) -> list:
    """The documents of a YAML text; empty ones are left out."""
    out = []
    for part in re.split(r"(?m)^(?:---(?:[ \t].*)?|\.\.\.[ \t]*)$", text.replace("\r\n", "\n")):
        lines = _Lines(part.split("\n"))
        if lines.rows:
            out.append(lines.block(0))
            if lines.at < len(lines.rows):
                raise ValueError(f"not read: {lines.rows[lines.at][2]}")
    return out

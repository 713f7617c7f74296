"""The normaliser of a piece model as a deterministic transducer.

Its rules are read out of the model's packed table and compiled into a trie of
code points; at each place the longest rule that fits is applied, otherwise a code
point passes through. White space is then handled as the model says: runs are
made one, ends are cut, a leading or a closing mark is added, and blanks are
written as marks.

Cases: an empty text, or one of which nothing is left, stays empty.
"""

from __future__ import annotations

import re

import numpy as np

MARK = "▁"


def rules_of(table: bytes) -> dict[str, str]:
    """The rules of a packed table: the size of a double array of 32-bit units, the array, and the replacements, each ended by a zero byte."""
    if not table:
        return {}
    size = int.from_bytes(table[:4], "little")
    units, values = np.frombuffer(table[4 : 4 + size], dtype="<u4"), table[4 + size :]
    offset = lambda unit: int(unit >> 10) << int((unit & 512) >> 6)
    labels = np.arange(1, 256, dtype=np.uint32)
    rules, todo = {}, [(offset(units[0]), b"")]
    while todo:
        base, key = todo.pop()
        at = base ^ labels.astype(np.int64)
        inside = at < len(units)
        fits = np.zeros(255, dtype=bool)
        fits[inside] = (units[at[inside]] & np.uint32(0x800000FF)) == labels[inside]
        for label in labels[fits].tolist():
            unit = units[base ^ label]
            child, longer = (base ^ label) ^ offset(unit), key + bytes([label])
            if unit >> 8 & 1:
                start = int(units[child] & np.uint32(0x7FFFFFFF))
                rules[longer.decode(errors="replace")] = values[start : values.index(b"\0", start)].decode()
            todo.append((child, longer))
    return rules


class Normaliser:
    def __init__(self, spec, suffix: bool = False):
        self.rules = rules_of(spec.precompiled_charsmap)
        self.mark = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = suffix
        self._ready()

    def _ready(self):
        self.longest: dict[str, int] = {}
        for rule in self.rules:
            self.longest[rule[0]] = max(self.longest.get(rule[0], 0), len(rule))
        self.starts = re.compile("[" + re.escape("".join(sorted(self.longest))) + "]") if self.rules else None
        self.space = MARK if self.escape else " "

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("longest", "starts")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def replaced(self, text: str) -> str:
        if self.starts is None:
            return text
        out, at = [], 0
        while found := self.starts.search(text, at):
            i = found.start()
            out.append(text[at:i])
            for n in range(self.longest[text[i]], 0, -1):
                new = self.rules.get(text[i : i + n])
                if new is not None and len(text) >= i + n:
                    out.append(new)
                    at = i + n
                    break
            else:
                out.append(text[i])
                at = i + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.replaced(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.escape:
            text = text.replace(" ", MARK)
        if self.mark:
            text = text + self.space if self.suffix else self.space + text
        return text

"""Token counts by a compiled finite-state tokenizer.

Three machines are compiled from the tokenizer file on the driver.
The normaliser's tables of case, composition and character classes come from the
tokenizer's own library, code point by code point, as Python's may be of another
Unicode version; only code points that differ are kept (see UnicodeTables). The
scanner finds the words. The word machine is a deterministic transducer over a
word's bytes: its states are built when first reached, and each transition adds
tokens to the count of the prefix (less than 0 where tokens merge); a state holds
the sum along its path, so a word's count is read off its last state.

A text longer than CHUNK code points is cut into chunks that are read in tasks of
their own. White space brings the scanner into its first state from any other, so
a chunk's state map is: what it reads before its first white space (which depends
on the state it is entered in), the tokens emitted between the first and the last
white space (which don't), and what it reads after. These maps form a monoid; the
scan composes neighbours in rounds, all pairs of a round at once and a logarithmic
number of rounds. Only the total is wanted, so the scan's way down is left out.

Cases: a null or empty text has 0 bytes and 0 tokens; white space alone has 0
tokens. Special strings inside a text count as the library's default has it: 1
each. Texts of any length are read whole; repeated rows are counted alike; an
empty table gives an empty result. Other columns pass through; columns n_bytes,
n_tokens and over_limit are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_paths import NEVER, SHARED, MergeTable, PathFinder
from .common import Memo, map_arrow, with_fields

END = "\n"  # stands for the word end in token strings; no byte is written so
CHUNK = 1 << 18  # code points
KEEP = 250_000
STATES = 600_000  # states of the word machine in each worker
SHORT = 40
DEAD = (None, 0)
ODD_BLANKS = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer


def byte_names() -> list[str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordMerges(MergeTable):
    def __init__(self, merges: list[list[str]]):
        pairs = [(a.replace("</w>", END), b.replace("</w>", END)) for a, b in merges]
        self.rank_of = {pair: r for r, pair in enumerate(pairs)}
        made: dict[str, int] = {}
        for r, (a, b) in enumerate(pairs):
            made.setdefault(a + b, r)
        super().__init__(lambda t: [*t[:-2], t[-2:]] if t[-1:] == END else list(t), made)

    def rank(self, a, b):
        return self.rank_of.get((a, b), NEVER)


class UnicodeTables:
    """Where the tokenizer library's Unicode differs from Python's: compiled code point by code point, or probed."""

    def __init__(self):
        from tokenizers import Regex, normalizers, pre_tokenizers

        import regex

        every = [chr(c) for c in range(0x110000) if c != 10 and not 0xD800 <= c < 0xE000]
        through = lambda n, texts: n.normalize_str("\n".join(texts)).split("\n")
        lowered = through(normalizers.Lowercase(), every)
        self.lower = {c: x for c, x in zip(every, lowered, strict=True) if x != c.lower()}
        # A code point is of another combining class where it changes places with marks of a high or a low class otherwise.
        self.composed: set[str] = set()
        for form, probe in (("NFD", "{}"), ("NFC", "{}"), ("NFC", "\u0345{}"), ("NFC", "{}\u0334")):
            texts = [probe.format(c) for c in every]
            for c, t, x in zip(every, texts, through(getattr(normalizers, form)(), texts), strict=True):
                own = unicodedata.normalize(form, t)
                if x != own:
                    self.composed |= {c, *x, *own} - {"\u0345", "\u0334"} if form == "NFD" else {c}
        whole = "".join(every)
        self.stand_in: dict[int, str] = {}
        classes = {}
        for name, own in (("L", "x"), ("N", "1"), ("s", " ")):
            pattern = r"\s" if name == "s" else rf"\p{{{name}}}"
            split = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True)
            classes[name] = {c for run, _ in split.pre_tokenize_str(whole) for c in run} | ({"\n"} if name == "s" else set())
            differ = classes[name] ^ set(regex.findall(pattern, whole + "\n"))
            self.stand_in |= {ord(c): "#" for c in differ if ord(c) not in self.stand_in}
            self.stand_in |= {ord(c): own for c in differ & classes[name]}
        self.blanks = "".join(sorted(classes["s"]))
        self.odd = frozenset(self.composed) | frozenset(self.lower) - {"Σ"}
        self.first_odd = min(self.odd, default="\U0010ffff")


@lru_cache(maxsize=1)
def unicode_tables() -> UnicodeTables:
    return UnicodeTables()


class WordMachine:
    """Reads a word's symbols; each transition adds some tokens to the count of the prefix read so far.

    The states form a tree: a prefix has one state, which holds its last token (None
    where no token ends there) and the sum of what the transitions on the way to it
    add. So reading goes on from the longest prefix known, and the end of a known word
    is found at once. All states are forgotten when there are too many, and are built
    again when they are reached; those of long words aren't kept.
    """

    def __init__(self, finder: PathFinder, limit: int = STATES):
        self.finder, self.limit, self.states = finder, limit, {}

    def count(self, word: str) -> int:
        states = self.states
        state = states.get(word)
        if state is not None:
            return state[1]
        n = k = len(word)
        if n > SHARED:
            states, k = {}, 0
        elif len(states) >= self.limit:
            states.clear()
        while k and word[:k] not in states:
            k -= 1
        finder = self.finder
        tokens, longest, good, bad, agree = finder.tokens, finder.longest, finder.good, finder.bad, finder.agree
        for j in range(k + 1, n + 1):
            state = DEAD
            for i in range(j - 1, max(-1, j - longest - 1), -1):
                piece = word[i:j]
                if piece in tokens:
                    if i == 0:
                        state = (piece, 1)
                        break
                    token, before = states[word[:i]] if n <= SHARED else states[i]
                    pair = (token, piece)
                    if pair in good or token is not None and pair not in bad and agree(pair):
                        state = (piece, before + 1)
                        break
            if n <= SHARED:
                states[word[:j]] = state
            else:
                states[j] = state
        return state[1]


class CountingTokenizer:
    """Compiled from a tokenizer file of lower-casing word byte-pair encoding."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a lower-casing byte-pair tokenizer with word ends is needed")
        self.merges = model["merges"]
        self.tokens = [t.replace("</w>", END) for t in model["vocab"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.tables = unicode_tables()
        self._ready()

    def _ready(self):
        import regex

        self.machine = WordMachine(PathFinder(WordMerges(self.merges), self.tokens, max(map(len, self.tokens))))
        self.scan = regex.compile(self.pattern)
        self.names = dict(enumerate(byte_names()))
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.blanks = re.compile(f"[{re.escape(self.tables.blanks)}]+")
        self.far = re.compile(f"[{self.tables.first_odd}-\U0010ffff]")
        self.odd_words = frozenset(map(chr, self.tables.stand_in))
        self.memo = Memo(self._run, KEEP)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("merges", "tokens", "special", "pattern", "tables")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _word(self, word: str) -> int:
        return self.machine.count(word.encode().decode("latin-1").translate(self.names) + END)

    def _run(self, run: str) -> int:
        """Tokens of a run without white space."""
        if run.isascii() or self.odd_words.isdisjoint(run):
            return sum(map(self._word, self.scan.findall(run)))
        # Code points of another class in the library are read as one that has it.
        return sum(self._word(run[m.start() : m.end()]) for m in self.scan.finditer(run.translate(self.tables.stand_in)))

    def _normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        tables = self.tables
        if self.far.search(text) is None or tables.odd.isdisjoint(text):
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        from tokenizers import normalizers

        text = normalizers.NFC().normalize_str(text) if not tables.composed.isdisjoint(text) else unicodedata.normalize("NFC", text)
        return "".join([tables.lower.get(c) or c.lower() for c in text])

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        text = self._normalised(text)
        # str.split knows the same white space but for four control characters, which it has in addition.
        runs = [r for r in self.blanks.split(text) if r] if ODD_BLANKS.search(text) else text.split()
        memo = self.memo
        return sum([memo[r] if len(r) <= SHORT else self._run(r) for r in runs])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" in text:
            parts = self.specials.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(read before the first white space, tokens up to the last, read after it); None where there is no white space."""
        first = self.blanks.search(chunk)
        if first is None:
            return chunk, None, ""
        last = len(chunk)
        while self.blanks.match(chunk, last - 1) is None:
            last -= 1
        return chunk[: first.start()], self.count(chunk[first.start() : last]), chunk[last:]

    def compose(self, a, b):
        """The map of two chunks in a row. White space takes no part in composition or case, so what lies between is read on its own."""
        (head, n, tail), (head2, n2, tail2) = a, b
        if n is None:
            return head + head2, n2, tail2
        if n2 is None:
            return head, n, tail + head2
        return head, n + self.count(tail + head2) + n2, tail2

    def scanned(self, maps: list) -> int:
        """Tokens of a text from its chunks' maps, composed in rounds of neighbours."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0] if maps else ("", None, "")
        return self.count(head) + (n or 0) + self.count(tail)


def long_counts(texts: DataFrame, machine, chunk: int) -> DataFrame:
    """(digest, n) of the distinct long texts (digest, text): chunks are read in tasks of their own, then their maps composed."""

    def cut(frames):
        for frame in frames:
            for digest, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                for i in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([i // chunk], pa.int64()), pa.array([text[i : i + chunk]])], names=["digest", "i", "part"])

    def read(frames):
        for frame in frames:
            maps = [machine.value.chunk_map(p) for p in frame.column(2).to_pylist()]
            columns = [pa.array([m[k] for m in maps], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), *columns], names=["digest", "i", "head", "n", "tail"])

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        maps = list(zip(*(table.column(c).to_pylist() for c in ("head", "n", "tail")), strict=True))
        return pa.table({"digest": pa.array([table.column("digest")[0].as_py()]), "n": pa.array([machine.value.scanned(maps)], pa.int64())})

    parts = texts.mapInArrow(cut, "digest string, i long, part string").dropDuplicates(["digest", "i"])  # copies are read once
    maps = parts.mapInArrow(read, "digest string, i long, head string, n long, tail string")
    return maps.groupBy("digest").applyInArrow(compose, "digest string, n long")


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens of each whole text, and whether it has more than limit tokens."""
    machine = docs.sparkSession.sparkContext.broadcast(CountingTokenizer(tokenizer_file))  # bounded by the vocabulary
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    names, at = docs.columns, docs.columns.index(text)
    whole = F.col(f"`{text}`")
    own = [F.col(f"`{c}`") for c in names]

    def run(frames):
        for frame in frames:
            n = [machine.value.count(t) for t in frame.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    is_long = F.coalesce(F.char_length(whole), F.lit(0)) > chunk
    short = map_arrow(docs.filter(~is_long), run, with_fields(docs.schema, n_tokens="long"))
    long_ = docs.filter(is_long).select(*own, F.sha2(whole, 256).alias("·digest"))
    known = long_counts(long_.select(F.col("·digest").alias("digest"), whole.alias("text")), machine, chunk).toDF("·digest", "·n")
    counted = short.unionByName(long_.join(known, "·digest").select(*own, F.col("·n").alias("n_tokens")))
    size = F.coalesce(F.octet_length(whole), F.lit(0)).cast("long")
    return counted.select(*own, size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

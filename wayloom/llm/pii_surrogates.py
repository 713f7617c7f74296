"""Surrogates for personal data: keyed, of the same type, gender, script and format, distinct and coreferent.

1. Detection finds e-mail and IP addresses, phone, card, bank account and social
   security numbers, secrets, and names: after titles, with known first names, and
   pairs of capitalised words whose context speaks for a person. The context is a
   sum of weights (CONTEXT) for the word before, the word after, an address beside
   the pair, a name to which it is joined, and words that people aren't called by.
2. Each distinct entity, in a canonical form, gets a surrogate from a keyed hash:
   digits become digits, letters letters of their script and case, valid check
   digits and country codes stay valid. Names are made of syllables of their
   script, with endings by gender for first names; so there are as many as a
   corpus needs, and none is one of the names that detection looks for.
3. Collision checks over the whole corpus: a surrogate that another entity of
   the type has too, or that is itself an entity found in the corpus, is drawn
   again, in rounds, until all are distinct. So different entities stay
   different, and one entity has one surrogate in all documents; name parts
   have surrogates of their own, so a surname alone goes with its full name.
4. The surrogate is written in each mention's own format and capitals.

Cases: null and empty texts stay as they are with no spans; overlapping finds
keep the more specific one; rows of equal id and text are treated alike. Columns
text, n_entities and spans are replaced, others pass through.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_arrow, with_fields, written

# First names by gender and script, and titles by gender.
FEMALE = "Maria Anna Sophie Emma Laura Julia Lisa Sarah Marie Camille Claire Lucia Carmen Elena Isabel Ana Mary Jennifer Susan Linda Karen Jessica Emily Alice Julie Katharina Sabine Petra Monika Nathalie"
MALE = "John James Robert Michael William David Thomas Peter Hans Karl Stefan Andreas Klaus Jean Pierre Michel Nicolas Carlos Juan Jose Luis Miguel Pedro Daniel Paul Mark George Martin Felix Antoine"
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия"
MALE_CYRILLIC = "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел Олег"
TITLES = {"f": "Mrs Ms Miss Frau Mme Mlle Madame Señora Sra", "m": "Mr Herr Monsieur Señor Sr", "": "Dr Prof"}
FIRST = {("f", "LATIN"): FEMALE.split(), ("m", "LATIN"): MALE.split(), ("f", "CYRILLIC"): FEMALE_CYRILLIC.split(), ("m", "CYRILLIC"): MALE_CYRILLIC.split()}
GENDER = {n.casefold(): g for (g, _), names in FIRST.items() for n in names}
TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts.split()}
CUES = frozenset([n for names in FIRST.values() for n in names] + list(TITLE_GENDER))
# Made names: (consonants, vowels) of a script, endings of first names by gender, of which none is the end of one of the other gender, and endings of surnames.
SOUNDS = {"LATIN": ("bcdfghjklmnprstvwz", "aeiou"), "CYRILLIC": ("бвгджзклмнпрстфхцч", "аеиоу"), "GREEK": ("βγδζθκλμνξπρστφχψ", "αειου")}
ENDINGS = {
    ("f", "LATIN"): "a ia ina ella ette ine elle".split(),
    ("m", "LATIN"): "o us ard bert rik son mund".split(),
    ("f", "CYRILLIC"): "а ия ина ела ета".split(),
    ("m", "CYRILLIC"): "ий ан ислав имир ент".split(),
    ("f", "GREEK"): "α ια ινα η".split(),
    ("m", "GREEK"): "ων ωρ ηλ".split(),  # a final sigma would not outlive case folding
    ("last", "LATIN"): "er mann sen ez is ley ton ard".split(),
    ("last", "CYRILLIC"): "ов ев ко ук ич ян".split(),
    ("last", "GREEK"): "ου ακη ιδη ατου".split(),
}
LETTERS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшщэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}

CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][\w'’]+"
NAME = re.compile(rf"(?:\b(?P<title>{'|'.join(TITLE_GENDER)})\.?[ ]+(?P<a>{CAPITAL})(?:[ ](?P<b>{CAPITAL}))?|\b(?P<c>{'|'.join(n for names in FIRST.values() for n in names)})[ ](?P<d>{CAPITAL}))(?!\w)")
PATTERNS = [
    ("secret", re.compile(r"""\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b["']?\s*[:=]\s*["']?([^\s"'<>;,]{6,})""", re.I)),
    ("secret", re.compile(r"(?<![\w@])((?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-f]{24,}|[0-9A-F]{24,})|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16})(?![\w@])")),
    ("email", re.compile(r"(?<![\w.+-])([\w.+-]+@[\w-]+(?:\.[\w-]*\w)+)")),
    ("iban", re.compile(r"(?<!\w)([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")),
    ("card", re.compile(r"(?<![\w.-])(\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}(?:[ -]?\d{1,3})?)(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])((?:\d{1,3}\.){3}\d{1,3})(?!\w|\.\d)")),
    ("phone", re.compile(r"(?<![\w.+(])(\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,5}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)")),
]
# What every find of PATTERNS or NAME holds, so that other texts need no search: one of these, and a cue as a whole word.
# Weights of a pair's context; LEAST and more make it a name.
CONTEXT = {
    "before": {
        2: "contact dear attn sincerely regards signed author named name called meet kontakt liebe lieber grüße gez namens contacter cher chère signé nommé nommée cordialement querido querida estimado estimada atentamente llamado llamada firmado nombre nom контакт уважаемый уважаемая автор",
        1: "by from with von mit par avec por con autor auteur written geschrieben écrit escrito",
    },
    "after": {1: "said says wrote writes asked replied born lives sagte sagt schrieb geboren wohnt dit écrit né née habite dijo escribió nacido nacida vive сказал сказала"},
    "never": "Support Service Services Team Customer Sales Office Department Us Information Center Centre Company Inc Ltd GmbH University Institute Street Avenue Road Sir Madam Friends Colleagues Damen Herren Kundendienst Equipe Servicio",
}
BEFORE = {w: n for n, ws in CONTEXT["before"].items() for w in ws.split()}
AFTER = {w: n for n, ws in CONTEXT["after"].items() for w in ws.split()}
NEVER_NAMES = frozenset(CONTEXT["never"].split())
LEAST, ADDRESS, JOINED = 2, 2, 2
PAIR = re.compile(rf"(?<!\w)(?P<a>{CAPITAL})(?=[ ](?P<b>{CAPITAL})(?!\w))")
WORD_BEFORE, WORD_AFTER = re.compile(r"(\w+)[ ,:]*\Z"), re.compile(r"[ ,]*(\w+)")
BESIDE = re.compile(r"[ ,]*[<(\[]?\s*(?:[\w.+-]+@|mailto:)")
JOINS = re.compile(r"\s*(?:,|&|and|or|und|oder|et|ou|y|o|e|и|или)?\s+\Z")
SUSPECT = re.compile(r"[\d@:=]|(?:sk|pk|ghp|gho|xox[bp])[-_]|AKIA")
WORD = re.compile(r"\w+")
WORD_OF_NAME = re.compile(r"\w[\w'’]*")
NUMERIC = {"card", "ssn", "phone"}
# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def canonical(kind: str, surface: str) -> str:
    if kind in NUMERIC:
        return "+" * surface.startswith("+") + re.sub(r"\D", "", surface)
    if kind == "iban":
        return surface.replace(" ", "")
    return surface.casefold() if kind in ("email", "first", "last") else surface


def script_of(text: str) -> str:
    names = [unicodedata.name(c, "").split(" ")[0] for c in text if c.isalpha()]
    return next((s for s in ("CYRILLIC", "GREEK") if s in names), "LATIN")


def valid(kind: str, surface: str) -> bool:
    digits = re.sub(r"\D", "", surface)
    if kind == "ip":
        return all(int(x) < 256 for x in surface.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19
    if kind == "iban":
        return 15 <= len(surface.replace(" ", "")) <= 34 and iban_rest(surface.replace(" ", "")) == 1
    return kind != "phone" or 7 <= len(digits) <= 15


def detect(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, gender, canonical form) of each entity, in code points, in order, without overlaps."""
    if not text:
        return []
    out: list[tuple[int, int, str, str, str]] = []  # in order

    def add(kind, gender, start, end):
        at = bisect.bisect(out, (start, end))
        if (at == 0 or out[at - 1][1] <= start) and (at == len(out) or end <= out[at][0]):
            out.insert(at, (start, end, kind, gender, canonical(kind, text[start:end])))

    if SUSPECT.search(text):
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                if valid(kind, m[1]):
                    add(kind, "", *m.span(1))
    if not CUES.isdisjoint(WORD.findall(text)):
        for m in NAME.finditer(text):
            gender = TITLE_GENDER.get(m["title"] or "", "")
            if m["c"]:
                add("first", GENDER[m["c"].casefold()], *m.span("c"))
                add("last", "", *m.span("d"))
            elif m["b"]:
                add("first", gender or GENDER.get(m["a"].casefold(), ""), *m.span("a"))
                add("last", "", *m.span("b"))
            else:
                add("last", "", *m.span("a"))
    ends = {e for _, e, kind, _, _ in out if kind == "last"}
    for m in PAIR.finditer(text):
        if in_context(text, m, ends):
            add("first", GENDER.get(m["a"].casefold(), ""), *m.span("a"))
            add("last", "", *m.span("b"))
            ends.add(m.end("b"))
    alone = {text[a:b] for a, b, kind, _, _ in out if kind == "last"}  # later mentions of a surname alone
    if alone:
        for m in WORD_OF_NAME.finditer(text):
            if m[0] in alone:
                add("last", "", *m.span())
    return out


def in_context(text: str, pair: re.Match, ends: set[int]) -> bool:
    """Whether the context of two capitalised words speaks for a name; ends: where names end that are found already."""
    if not NEVER_NAMES.isdisjoint(pair.groups()) or pair["a"].casefold() in BEFORE:
        return False
    start, end = pair.start("a"), pair.end("b")
    before = text[max(0, start - 40) : start]
    word = WORD_BEFORE.search(before)
    score = BEFORE.get(word[1].casefold(), 0) if word else 0
    after = WORD_AFTER.match(text, end)
    score += AFTER.get(after[1].casefold(), 0) if after else 0
    if BESIDE.match(text, end):
        score += ADDRESS
    joined = JOINS.search(before)
    if joined and start - (len(before) - joined.start()) in ends:
        score += JOINED
    return score >= LEAST


class Draws:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, *parts):
        self.key, self.seed, self.n, self.held = key, "\x00".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 8:
            self.held = hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha512).digest()
            self.n += 1
        value, self.held = int.from_bytes(self.held[:8], "big"), self.held[8:]
        return value % n


@lru_cache(maxsize=4096)
def letters_like(c: str) -> str:
    """The small letters of a letter's script; of scripts without a list of their own those of its neighbourhood in the code table."""
    script = unicodedata.name(c, "").split(" ")[0]
    if script in LETTERS:
        return LETTERS[script]
    base = ord(c) & ~63
    return "".join(x for x in map(chr, range(base, base + 64)) if x.isalpha() and x.isupper() == c.isupper() and unicodedata.name(x, "").split(" ")[0] == script) or c


def same_shape(text: str, draws: Draws, hexadecimal: bool = False) -> str:
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draws.below(10)))
        elif c.isalpha():
            letters = "abcdef" if hexadecimal else letters_like(c)
            new = letters[draws.below(len(letters))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def made_name(gender: str, script: str, syllables: int, draws: Draws) -> str:
    """A first name of a gender, or a surname. A further syllable makes the space some 90 times as large."""
    consonants, vowels = SOUNDS[script]
    while True:
        stem = "".join(consonants[draws.below(len(consonants))] + vowels[draws.below(len(vowels))] for _ in range(syllables))
        endings = ENDINGS[gender, script]
        name = stem + consonants[draws.below(len(consonants))] + endings[draws.below(len(endings))]
        if name.capitalize() not in CUES:
            return name


def country_code(digits: str) -> int:
    """The length of an international number's country code."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3


def surrogate(key: bytes, kind: str, gender: str, canon: str, attempt: int) -> str:
    """The canonical form of an entity's surrogate; from the 16th attempt on it may be longer."""
    draws = Draws(key, kind, canon, attempt)
    longer = "x" * max(0, attempt - 15)
    if kind == "first" or kind == "last":
        script = script_of(canon)
        form = "last" if kind == "last" else gender or "fm"[draws.below(2)]
        return made_name(form, script, 1 + (kind == "last") + attempt // 2, draws)
    if kind == "phone" and canon[0] == "+":
        kept = 1 + country_code(canon[1:])
        return canon[:kept] + (str(draws.below(9) + 1) if canon[kept : kept + 1] not in ("", "0") else canon[kept : kept + 1]) + same_shape(canon[kept + 1 :], draws)
    if kind == "ip":
        return ".".join(str(draws.below(254) + 1) for _ in range(4))
    if kind == "email":
        local, domain = canon.split("@", 1)
        host, _, top = domain.rpartition(".")
        return f"{same_shape(local + longer, draws)}@{same_shape(host, draws)}.{top}"
    if kind == "iban":
        body = same_shape(canon[4:], draws)
        return f"{canon[:2]}{98 - iban_rest(canon[:2] + '00' + body):02d}{body}"
    if kind == "card":
        out = canon[0] + same_shape(canon[1:], draws)
        return out[:-1] + str((10 - luhn(out[:-1] + "0")) % 10) if luhn(canon) == 0 else out
    if kind == "secret":
        return same_shape(canon, draws, re.fullmatch("[0-9a-fA-F]+", canon) is not None) + longer
    return same_shape(canon, draws)


def render(kind: str, surface: str, value: str) -> str:
    """A surrogate in the format of a mention."""
    if kind in NUMERIC or kind == "iban":
        left = iter(value.removeprefix("+"))
        return "".join(next(left, "") if c.isalnum() else c for c in surface) + "".join(left)
    if kind in ("first", "last"):
        if surface.isupper() and len(surface) > 1:
            return value.upper()
        return "".join(c.upper() if k < len(surface) and surface[k].isupper() else c for k, c in enumerate(value))
    if kind == "email" and surface.isupper():
        return value.upper()
    return value


def found_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"d {kind}, t long, start int, stop int, kind string, gender string, canon string"

    def run(frames):
        for frame in frames:
            rows = [(k, *s) for k, x in enumerate(frame.column(2).to_pylist()) for s in detect(x)]
            at = pa.array([r[0] for r in rows], pa.int64())
            own = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.string()), (5, pa.string()))]
            yield pa.RecordBatch.from_arrays([frame.column(0).take(at), frame.column(1).take(at), *own], names=["d", "t", "start", "stop", "kind", "gender", "canon"])

    whole = F.col(f"`{text}`")
    return docs.filter(whole.isNotNull()).select(F.col(f"`{doc_id}`").alias("d"), F.xxhash64(whole).alias("t"), whole.alias("text")).mapInArrow(run, schema)


def surrogates_of(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon, gender), with all collisions resolved."""

    def draw(frames):
        for frame in frames:
            kinds, canons, genders, attempts = (frame.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array([surrogate(key, *row) for row in zip(kinds, genders, canons, attempts, strict=True)], pa.string())], names=["kind", "canon", "gender", "attempt", "surrogate"])

    schema = "kind string, canon string, gender string, attempt int, surrogate string"
    drawn = lambda df: df.select("kind", "canon", "gender", "attempt").mapInArrow(draw, schema)
    originals = written(entities.select("kind", F.col("canon").alias("surrogate"), F.lit(1).alias("real")))
    state = written(drawn(entities.withColumn("attempt", F.lit(0))))
    while True:
        # The entity that has drawn a surrogate for longest keeps it, then the first by name; names found in the corpus are never surrogates.
        owner = state.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("own"), F.count("*").alias("n"))
        judged = state.join(owner, ["kind", "surrogate"]).join(originals, ["kind", "surrogate"], "left")
        judged = written(judged.select("kind", "canon", "gender", "attempt", "surrogate", ((F.col("own.canon") != F.col("canon")) | F.col("real").isNotNull()).alias("clash")))
        again = judged.filter("clash")
        if not again.limit(1).count():
            dropped(originals)
            return judged.select("kind", "canon", "surrogate")
        dropped(state)
        state = written(judged.filter("NOT clash").drop("clash").unionByName(drawn(again.withColumn("attempt", F.col("attempt") + 1))))
        dropped(judged)


def with_surrogates(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with surrogates in text, n_entities, and spans (start, stop in the old text, kind, surrogate)."""
    docs = docs.drop("n_entities", "spans")
    spans = written(found_spans(docs, doc_id, text))
    # Gender is a property of the first name in all its mentions; the one found most decides nothing, the greatest does.
    entities = spans.groupBy("kind", "canon").agg(F.max("gender").alias("gender"))
    mapping = surrogates_of(entities, key)
    placed = spans.join(mapping, ["kind", "canon"]).select("d", "t", F.struct("start", "stop", "kind", "surrogate").alias("x")).distinct()
    by_doc = placed.groupBy(F.col("d").alias("·d"), F.col("t").alias("·t")).agg(F.array_sort(F.collect_list("x")).alias("·x"))
    names = docs.columns
    whole = F.col(f"`{text}`")
    joined = docs.withColumn("·h", F.xxhash64(whole)).join(by_doc, F.expr(f"`{doc_id}` <=> `·d` AND `·h` = `·t`"), "left").select(*[F.col(f"`{c}`") for c in names], F.col("·x").alias("spans"))
    at, last = names.index(text), len(names)

    def run(frames):
        for frame in frames:
            texts, lists = frame.column(at).to_pylist(), frame.column(last).to_pylist()
            new = []
            for old, own in zip(texts, lists, strict=True):
                for s in reversed(own or []):
                    a, b = s["start"], s["stop"]
                    old = old[:a] + render(s["kind"], old[a:b], s["surrogate"]) + old[b:]
                new.append(old)
            columns = list(frame.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x or []) for x in lists], pa.int64())], names=[*names, "spans", "n_entities"])

    return map_arrow(joined, run, with_fields(joined.schema, n_entities="long"))

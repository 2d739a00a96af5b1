"""PII surrogates: detected entities get keyed, type-consistent stand-ins.

Detection is by pattern and checksum: mail addresses, phone and card numbers, network addresses, access keys,
secrets behind words like ``password=`` or ``token =``, card numbers only with a valid checksum, and person names behind a title or from a list of given names.
A card number may stand beside other digits: all stretches of 13 to 19 digits between group borders of a run of digits are tried (``cards_in``).
A surrogate is drawn by a keyed hash (HMAC-SHA256) of the kind and the normalised entity, so the same entity has the same
surrogate wherever it stands (coreference), whatever its writing: surrogates are drawn for the normalised form and then written in
the format of the occurrence. Digits become digits, letters letters of the same case and script, separators stay (symbols of a secret
of fewer than ``FEW`` letters and digits become symbols); card numbers
keep their issuer digit and satisfy the checksum, addresses stay in their private or public range, names keep gender and script.
The gender of a name is one for the corpus: that of a listed given name, else of a title (the first of f and m that occurs), else drawn.

Distinctness: surrogates are drawn for all distinct entities of the corpus (one shuffle of entities, combined before it, never of texts),
and joined with themselves: entities that share a surrogate, or whose surrogate is itself an entity of the corpus, draw again with the
next attempt number until none is left; of several that share one, the least entity keeps it. From attempt ``WIDER`` on, surrogates come
from wider pools (longer secrets and mail names, all of 10.0.0.0/8, then of 240.0.0.0/4), and from ``PLAIN`` on they are the kind with a drawn number, so the rounds end. Texts then take the final surrogates; only
those that needed another attempt, or whose occurrences differ in gender, are looked up, the others are drawn in place from the key.

The redrawn entities travel with the tasks as a table: it is broadcast only up to ``MOST_REDRAWN`` rows (their number is counted first);
beyond, they are joined to the documents that hold them.

Cases: null texts stay null, empty ones empty, texts without entities unchanged. Repeated rows change alike. An empty table gives no
rows. All columns of the documents are kept; ``n_chars`` is counted anew where there is one.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm.columns import unused
from eventlake.llm.shipping import ship
from eventlake.session import pinned

KEY_SETTING = "spark.eventlake.surrogates.key"
MOST_REDRAWN = 100_000
WIDER, WIDEST, PLAIN = 3, 8, 16  # attempts from which pools are wider, widest, and without the format of the entity
FEW = 4
SYMBOLS = "!#$%&*+-./:;<=>?@^_|~"

# Given names by gender and script (fixed values); family names by script.
GIVEN = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nina", "Paula", "Sarah", "Sofia", "Alice", "Helen", "Ruth"),
    ("m", "latin"): ("Adam", "Carlos", "Daniel", "David", "Hugo", "John", "Louis", "Lucas", "Martin", "Michael", "Paul", "Peter", "Robert", "Thomas", "James", "Simon"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Павел", "Юрий"),
}
FAMILY = {
    "latin": ("Berger", "Costa", "Dupont", "Fischer", "Garcia", "Keller", "Lambert", "Martinez", "Miller", "Moreau", "Navarro", "Parker", "Richter", "Santos", "Turner", "Walker"),
    "cyrillic": ("Иваненко", "Климов", "Лебедев", "Морозов", "Новиков", "Орлов", "Петренко", "Соколов"),
}
TITLES = {"Mr": "m", "Herr": "m", "Sr": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Sra": "f", "Madame": "f", "Dr": "", "Prof": ""}
GENDER = {name: gender for (gender, _), names in GIVEN.items() for name in names}

WORD = r"[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я]+"
PATTERNS = {
    "mail": r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*)(?P<q>[\"']?)(?P<secret_value>[^\s\"']{6,})(?P=q)",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "address": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w+-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "social": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12}",  # the least that is one; cards_in looks at the whole run of digits
    "name": r"\b(?:(?P<title>" + "|".join(TITLES) + r")\.? (?P<titled>" + WORD + r"(?: " + WORD + r")?)|(?P<listed>(?:" + "|".join(GENDER) + r") " + WORD + r"))\b",
}
ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
# A text without any of these holds no entity; each is a fast scan.
HINTS = (re.compile(r"[@=:0-9]"), re.compile("AKIA|ASIA"), re.compile(r"(?:" + "|".join([*TITLES, *GENDER]) + r")\b"))


def checksum_ok(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


DIGITS = re.compile(r"\d+")
CARD_RUN = re.compile(r"\d(?:[ -]?\d)*")
CARD_END = re.compile(r"(?![\w-]|\.\d)")
# Usual groups of digits, and first digits with their lengths.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20))}
ISSUER = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7]|35)\d{14}|3[47]\d{13}|3[0689]\d{12}|6\d{15,18}|5[06-8]\d{11,17}")


def cards_in(text: str, begin: int) -> tuple[list[tuple[int, int]], int]:
    """Card numbers in the run of digits at ``begin``, and where the run ends.

    Every stretch from group border to group border with a valid checksum is a candidate if it has usual groups or an issuer's digits,
    or is the longest one at ``begin`` before something else than a hyphen or word. Of candidates that overlap, the more usual one is taken,
    then one that does not cut a hyphenated number, then the longer one, then the first."""
    run = CARD_RUN.match(text, begin)
    groups = [found.span() for found in DIGITS.finditer(text, begin, run.end())]
    found, longest = [], begin
    for i, (a, _) in enumerate(groups):
        digits, sizes = "", []
        for x, b in groups[i : i + 19]:
            digits, sizes = digits + text[x:b], [*sizes, b - x]
            if len(digits) > 19:
                break
            # Inside the run a border is one separator; at its end nothing that continues a word or number may follow.
            ends = CARD_END.match(text, b)
            if len(digits) < 13 or b == run.end() and not ends:
                continue
            if a == begin and ends:
                longest = b
            usual = (tuple(sizes) in CARD_GROUPS and not {" ", "-"} <= set(text[a:b])) + bool(ISSUER.fullmatch(digits))
            if not (usual or a == begin) or not checksum_ok(digits):
                continue
            cuts = "-" not in text[a:b] and (a > begin and text[a - 1] == "-" or b < run.end() and text[b] == "-")
            found.append((-usual, cuts, a - b, a, b))
    taken: list[tuple[int, int]] = []
    inside: set[int] = set()
    for less, _, _, a, b in sorted(found):
        if (less or (a, b) == (begin, longest)) and inside.isdisjoint(range(a, b)):
            taken.append((a, b))
            inside.update(range(a, b))
    return sorted(taken), run.end()


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and text of every entity, in order."""
    if not text or not any(hint.search(text) for hint in HINTS):
        return
    at, judged, cards = 0, 0, []  # cards of the run of digits that was judged last, and its end
    while True:
        found = ANY.search(text, at)
        if found and found["card"] is not None and found.start() >= judged:
            cards, judged = cards_in(text, found.start())
        if cards and (not found or (found.start() if found["card"] is not None else found.end() - 1) >= cards[0][0]):  # the card comes before what was found, or in it
            start, end = cards.pop(0)
            at = end
            yield start, end, "card", text[start:end]
            continue
        if not found:
            return
        kind = next(name for name in PATTERNS if found[name] is not None)
        start, end = found.span(kind)
        if kind == "card" or kind == "address" and any(int(part) > 255 for part in found[kind].split(".")) or kind == "phone" and not 7 <= sum(c.isdigit() for c in found[kind]) <= 15:
            at = DIGITS.search(text, start).end()  # none, but one may begin a group later
            continue
        at = found.end()
        if kind == "secret":
            start, end = found.span("secret_value")
        elif kind == "name":
            start, end = found.span("titled" if found["titled"] else "listed")
            given, _, family = text[start:end].partition(" ")
            # A family name alone has the same surrogates for all genders.
            kind = "name:" + (GENDER.get(given) or TITLES[found["title"]] if family else "")
        yield start, end, kind, text[start:end]


def normal(kind: str, value: str) -> str:
    """One form for all writings of an entity."""
    if kind == "mail":
        return value.lower()
    if kind in ("phone", "card", "social"):
        return "".join(c for c in value if c.isdigit())
    return value


class Stream:
    """Numbers drawn by HMAC from a key, the entity and the attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.message, self.state, self.block = key, "\0".join(parts).encode(), 0, 0

    def below(self, n: int) -> int:
        if self.state < 1 << 64:
            digest = hmac.new(self.key, self.message + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.state, self.block = int.from_bytes(digest, "big") | 1 << 256, self.block + 1
        self.state, drawn = divmod(self.state, n)
        return drawn


@lru_cache(maxsize=4096)
def alike(c: str) -> str:
    """Characters near ``c`` of its category; ASCII ones where it has none."""
    at, category = ord(c) & ~63, unicodedata.category(c)
    near = "".join(chr(x) for x in range(at, at + 64) if unicodedata.category(chr(x)) == category)
    return near if len(near) > 1 else "abcdefghijklmnopqrstuvwxyz" if c.isalnum() else SYMBOLS


def like(value: str, draw: Stream, symbols: bool = False) -> str:
    """Digits for digits, letters for letters of the same case and script, other characters only with ``symbols``."""
    out = []
    for c in value:
        if c.isascii() and c.isdigit():
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z":
            # Hexadecimal letters stay hexadecimal, so keys in hexadecimal remain such.
            out.append(chr(97 + draw.below(6 if c <= "f" and set(value.lower()) <= set("0123456789abcdef") else 26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw.below(26)))
        elif "а" <= c.lower() <= "я":
            drawn = chr(ord("а") + draw.below(32))
            out.append(drawn.upper() if c.isupper() else drawn)
        elif c.isalnum() or symbols:
            near = SYMBOLS if c.isascii() else alike(c)
            out.append(near[draw.below(len(near))])
        else:
            out.append(c)
    return "".join(out)


def longer(draw: Stream, attempt: int) -> str:
    """What later attempts add to surrogates of any length: more with every attempt."""
    return like("a0" * (attempt - WIDER + 2), draw) if attempt >= WIDER else ""


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """Stand-in of a normalised entity."""
    draw = Stream(key, kind.split(":")[0], value, str(attempt))
    if attempt >= PLAIN:
        return f"{kind.split(':')[0]}-{draw.below(1 << 128):032x}"
    if kind == "mail":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        return f"{like(local, draw)}{longer(draw, attempt)}@" + ".".join([like(x, draw) if i < len(labels) - 2 or len(labels) == 2 and i == 0 else x for i, x in enumerate(labels)])
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        return next(body + str(d) for d in range(10) if checksum_ok(body + str(d)))
    if kind == "address":
        parts = value.split(".")
        private = ipaddress.ip_address(".".join(str(int(p)) for p in parts)).is_private
        if private and attempt >= WIDER:  # two octets may be too few for the entities of a network
            parts = ["10", *parts[1:]] if attempt < WIDEST else [str(240 + draw.below(15)), *parts[1:]]
        fixed = 0 if not private else 2 if attempt < WIDER else 1
        drawn = [str(1 + draw.below(254)) for _ in parts[fixed:]]
        if not private:
            drawn[0] = str((1, 2, 3, 5, 8, 9, 11, 20, 31, 44, 52, 61, 77, 84, 93, 109, 133, 151, 185, 201)[draw.below(20)])
        return ".".join(parts[:fixed] + drawn)
    if kind == "phone":
        code = len(value) - 10 if len(value) > 10 else 0
        return value[:code] + like(value[code:], draw)
    if kind == "access_key":
        return value[:4] + "".join((chr(65 + n) if n < 26 else str(n - 24)) for n in (draw.below(32) for _ in value[4:]))
    if kind.startswith("name"):
        gender = kind[5:] or ("f", "m")[Stream(key, "gender", value).below(2)]
        script = "cyrillic" if "а" <= value[0].lower() <= "я" else "latin"
        words = value.split(" ")
        family = FAMILY[script][draw.below(len(FAMILY[script]))]
        if attempt:  # lists are short: later attempts write their number as a second family name
            family += "-" + like(family, draw).capitalize()
        return f"{GIVEN[gender, script][draw.below(len(GIVEN[gender, script]))]} {family}" if len(words) > 1 else family
    if kind == "secret":
        return like(value, draw, symbols=sum(c.isalnum() for c in value) < FEW) + longer(draw, attempt)
    return like(value, draw)


def written(kind: str, drawn: str, occurrence: str) -> str:
    """A surrogate in the format of the occurrence."""
    if kind in ("phone", "card", "social") and drawn.isdigit():
        digits = iter(drawn)
        return "".join(next(digits) if c.isdigit() else c for c in occurrence)
    if kind == "mail":
        return "".join(d.upper() if c.isupper() else d for c, d in zip(occurrence, drawn, strict=True)) if len(occurrence) == len(drawn) else drawn
    return drawn


ENTITY = pa.schema([("kind", pa.string()), ("value", pa.string()), ("full", pa.string())])


def corpus_entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Distinct entities with their first surrogates: kind, value, full, mixed, drawn. Repeats within a batch leave the task once.

    ``full`` is the kind with the settled gender, ``mixed`` says whether an occurrence has another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(kind.split(":")[0], normal(kind, value), kind) for x in batch.column(0).to_pylist() for _, _, kind, value in entities(x)}
            yield pa.RecordBatch.from_pylist([dict(zip(ENTITY.names, row, strict=True)) for row in found], schema=ENTITY)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [surrogate(key, full, value) for full, value in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=[*batch.schema.names, "drawn"])

    gendered = F.when(F.col("full") != "name:", F.col("full"))
    settled = docs.select(text).mapInArrow(run, "kind string, value string, full string").groupBy("kind", "value").agg(
        F.coalesce(F.min(gendered), F.min("full")).alias("full"), (F.min("full") != F.max("full")).alias("mixed")
    )
    return settled.mapInArrow(first, "kind string, value string, full string, mixed boolean, drawn string")


def redrawn(known: DataFrame, key: bytes) -> DataFrame:
    """Final surrogates of the entities whose first one collided or whose gender is mixed: kind, value, full, attempt, drawn."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["drawn"] = surrogate(key, row["full"], row["value"], row["attempt"])
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    settled, tries = [], known.withColumn("attempt", F.lit(0))
    while True:
        held = [done.select("kind", "value", "drawn", F.lit(False).alias("free")) for done in settled]
        taken = tries.select("kind", "value", "drawn", F.lit(True).alias("free"))
        for frame in held:
            taken = taken.unionByName(frame)
        owners = taken.groupBy("kind", "drawn").agg(F.min(F.struct("free", "value")).alias("owner"))
        judged = tries.join(owners, ["kind", "drawn"]).join(known.select("kind", F.col("value").alias("drawn"), F.lit(True).alias("real")), ["kind", "drawn"], "left")
        judged = pinned(judged.withColumn("good", F.col("real").isNull() & ~(~F.col("owner.free")) & (F.col("owner.value") == F.col("value"))).select(*tries.columns, "good"))
        settled.append(judged.where("good").select(*tries.columns))
        left = judged.where("not good").withColumn("attempt", F.col("attempt") + 1).select(*tries.columns)
        if left.isEmpty():
            break
        tries = pinned(left.mapInArrow(again, left.schema))
    later = settled[1:]
    out = settled[0].where("attempt > 0 or mixed")
    for frame in later:
        out = out.unionByName(frame)
    return out.select("kind", "value", "full", "attempt", "drawn")


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's settings name; without one, a random key that lasts as long as the application."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return named.encode()
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def replace(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity replaced; ``count`` names a column for the number of entities, in place of one of that name."""
    ship(docs.sparkSession)
    known = pinned(corpus_entities(docs, key, text))
    changed = pinned(redrawn(known, key))
    n = changed.count()
    attempts: dict = {}
    given = docs
    if 0 < n <= MOST_REDRAWN:
        attempts = {(row.kind, row.value): (row.full, row.attempt) for row in changed.drop("drawn").collect()}  # at most MOST_REDRAWN rows
    shared = docs.sparkSession.sparkContext.broadcast(attempts)
    if n > MOST_REDRAWN:
        given = _with_attempts(docs, changed, text)
    names = given.columns
    at = names.index(text)
    own = len(docs.columns) if len(names) > len(docs.columns) else None
    kept = docs.columns if count is None else [name for name in docs.columns if name.lower() != count.lower()]
    schema = docs.select(*kept, *([F.lit(0).cast("long").alias(count)] if count else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            lookups = batch.column(own).to_pylist() if own is not None else None
            for i, x in enumerate(batch.column(at).to_pylist()):
                again = shared.value if lookups is None else {(e["kind"], e["value"]): (e["full"], e["attempt"]) for e in lookups[i] or ()}
                out, upto, found = [], 0, 0
                for start, end, kind, value in entities(x):
                    plain = normal(kind, value)
                    full, attempt = again.get((kind.split(":")[0], plain), (kind, 0))
                    out += [x[upto:start], written(kind, surrogate(key, full, plain, attempt), value)]
                    upto, found = end, found + 1
                texts.append("".join([*out, x[upto:]]) if found else x)
                counts.append(found)
            columns = {name: batch.column(i) for i, name in enumerate(names)}
            columns[text] = pa.array(texts, pa.string())
            if "n_chars" in columns and text == "text":
                lengths = pa.array([None if x is None else len(x) for x in texts], pa.int64())
                columns["n_chars"] = lengths.cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*[columns[name] for name in kept], *([pa.array(counts, pa.int64())] if count else [])], names=[*kept, *([count] if count else [])])

    return given.mapInArrow(run, schema)


def _with_attempts(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """Documents with the redrawn entities they hold, in a last column."""
    mark, attempts = unused(docs, "mark"), unused(docs, "attempts")
    hashed = F.xxhash64(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"mark": m, "kind": kind.split(":")[0], "value": normal(kind, value)}
                for m, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for _, _, kind, value in entities(x)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("mark", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))

    holds = docs.select(hashed.alias("mark"), text).mapInArrow(run, "mark long, kind string, value string").distinct()
    lists = holds.join(changed, ["kind", "value"]).groupBy(F.col("mark").alias(mark)).agg(F.collect_list(F.struct("kind", "value", "full", "attempt")).alias(attempts))
    return docs.withColumn(mark, hashed).join(lists, mark, "left").select(*docs.columns, attempts)

"""Personal data: detected entities get keyed surrogates of the same type, shape, script and gender."""

from __future__ import annotations

import hashlib
import os
import re
import string
import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annulus.llm.common import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The setting of a session that names the secret key.
SURROGATE_KEY = "spark.annulus.surrogate.key"
_own_keys: dict[str, bytes] = {}
ROUNDS = 8
#: Characters that are replaced together: below the 512 bits that two halves of a round's function have.
PIECE = 100
#: Up to so many names whose first surrogate is taken (under 100 bytes each) are broadcast; more are joined.
BROADCAST_NAMES = 100_000

#: Kinds, the first of which wins where spans overlap from the same start.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", re.ASCII),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w]|\.[0-9])", re.ASCII),
    "card": re.compile(r"(?<![\w-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w]|-[0-9])", re.ASCII),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|-[0-9])", re.ASCII),
    "phone": re.compile(r"(?<![\w+])(?:(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|(?:\+[0-9]{1,3}[\x20.-])?[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,4})(?![\w])", re.ASCII),
}

#: Marks of a local part. Those before its first letter or digit (bullets, emphasis, leader dots) don't count as its own.
MARKS = "._%+-"
LOCAL = MARKS + string.ascii_letters + string.digits
#: The rest of a run up to another @, and an address that ends at the first mark there, so that the next one's local part isn't taken for a domain.
RUN, BEFORE_NEXT = re.compile(r"@[A-Za-z0-9._%+-]*+@"), re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+?[A-Za-z]{2,}+(?=[._%+-])")

#: Titles that announce a person's name, by gender.
TITLES = {"m": "Mr Mister Sir Herr Monsieur Señor Don Signor господин κύριος", "f": "Mrs Ms Miss Madam Lady Frau Fräulein Madame Mme Mademoiselle Mlle Señora Señorita Doña Signora госпожа κυρία", "": "Dr Prof Professor Doctor"}
GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts.split()}
TITLE = re.compile(r"(?<!\w)(?i:(" + "|".join(sorted(GENDER, key=len, reverse=True)) + r"))\.?(?=[\x20\xa0][^\W\d_])")
#: A word after a title, without a possessive ending, and how many of them at most are its names.
WORD = r"[^\W\d_](?:[\w'’-]*?(?=['’]s(?![\w'’-]))|[\w'’-]*)"
NAME, NAMES, MENTION = re.compile(rf"[\x20\xa0]({WORD})"), 3, re.compile(rf"(?<!\w){WORD}")
#: Words in lower case that stand within names, and stay.
PARTICLES = frozenset("van von vom der den de del della di da dos du la le el al bin ibn ben ter ten zu zum zur af av".split())

#: Syllables that names are made of, and endings of given names by gender, for each script.
SYLLABLES = {"LATIN": "ba be bo da de do fa fe ga go ha ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se ta te ti to va ve vi", "CYRILLIC": "ба бе бо да де до га го ка ке ко ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се та те ти то ва ве ви", "GREEK": "βα βε βο δα δε δο γα γο κα κε κο λα λε λι λο μα με μι μο να νε νο πα πε ρα ρε ρι ρο σα σε τα τε τι το"}
ENDINGS = {"LATIN": {"m": "n", "f": "a", "": "l"}, "CYRILLIC": {"m": "н", "f": "я", "": "в"}, "GREEK": {"m": "ς", "f": "η", "": "ν"}}

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
PLACES = frozenset(LETTERS + LETTERS.upper() + DIGITS)
#: What stands for each letter and digit in a shape.
SHAPE = {ord(c): "a" for c in LETTERS + LETTERS.upper()} | {ord(c): "0" for c in DIGITS}


def _prf(key: bytes, *parts) -> int:
    """256 keyed bits."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest(), "big")


def displaced(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size) without a fixed point (size above 1): a Feistel network, walked until it falls in range, around a shift."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    low = (1 << half) - 1

    def walk(x: int, order) -> int:
        while True:
            left, right = x >> half, x & low
            for i in order:
                if order.step > 0:
                    left, right = right, left ^ (_prf(key, tweak, size, i, right) & low)
                else:
                    left, right = right ^ (_prf(key, tweak, size, i, left) & low), left
            x = left << half | right
            if x < size:
                return x

    inner = walk(value, range(0, ROUNDS, 1))
    shift = 1 + _prf(key, tweak, size, "shift") % (size - 1)
    return walk((inner + shift) % size, range(ROUNDS - 1, -1, -1))


def shaped(text: str, key: bytes, tweak: str) -> str:
    """text with its letters and digits replaced by others of the same class and case, and all else kept: one to one on texts of a shape, and no piece of PIECE characters with a letter or digit stays as it is.

    The pieces of a longer text are replaced in turn, each by a permutation that the pieces before it choose.
    """
    state, out = _prf(key, tweak, text.translate(SHAPE)), []
    for first in range(0, len(text), PIECE):
        piece = text[first : first + PIECE]
        out.append(_piece(piece, key, f"{state:x}"))
        state = _prf(key, "next", state, piece)
    return "".join(out)


def _piece(text: str, key: bytes, tweak: str) -> str:
    places = [(i, LETTERS if c.isalpha() else DIGITS) for i, c in enumerate(text) if c in PLACES]
    value, size = 0, 1
    for i, of in places:
        value, size = value * len(of) + of.index(text[i].lower()), size * len(of)
    value = displaced(value, size, key, tweak)
    out = list(text)
    for i, of in reversed(places):
        value, at = divmod(value, len(of))
        out[i] = of[at].upper() if text[i].isupper() else of[at]
    return "".join(out)


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def _luhn(digits: str) -> int:
    """The check digit that makes digits valid."""
    return -sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def email(text: str, key: bytes) -> str:
    local, domain = text.split("@")
    labels = domain.lower().split(".")
    if labels[-2:-1] != ["example"]:  # reserved names are nobody's
        *names, top = domain.split(".")
        domain = f"{shaped('.'.join(names), key, 'domain')}.{top}"
    return f"{shaped(local, key, 'local')}@{domain}"


def iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    body = shaped(plain[4:], key, "iban")
    worth = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    check = 98 - worth(body + plain[:2] + "00")
    if worth(plain[4:] + plain[:4]) != 1:  # an invalid number stays one, by the same difference
        check = (check + int(plain[2:4]) - (98 - worth(plain[4:] + plain[:2] + "00"))) % 100
    rest = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(rest) for c in text)


def ip(text: str, key: bytes) -> str:
    value = displaced(int.from_bytes(bytes(map(int, text.split("."))), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def card(text: str, key: bytes) -> str:
    digits = re.sub("[^0-9]", "", text)
    middle = shaped(digits[1:-1], key, f"card:{digits[0]}")
    off = (int(digits[-1]) - _luhn(digits[:-1])) % 10  # valid stays valid
    return _refill(text, f"{digits[0]}{middle}{(_luhn(digits[0] + middle) + off) % 10}")


def ssn(text: str, key: bytes) -> str:
    return shaped(text, key, "ssn")


def phone(text: str, key: bytes) -> str:
    """Country code and the class of the first digit stay; one number in two formats gets one surrogate."""
    digits = re.sub("[^0-9]", "", text)
    code = 0
    if text.startswith("+"):
        code = len(re.match(r"\+([0-9]{1,3})(?![0-9])|\+(1|[0-9]{2})", text).group().lstrip("+"))
    elif len(digits) == 11 and digits[0] == "1":
        code = 1
    area = digits[code:]
    first = "23456789" if area[0] in "23456789" else "01"
    size = len(first) * 10 ** (len(area) - 1)
    value = displaced(first.index(area[0]) * 10 ** (len(area) - 1) + int(area[1:] or "0"), size, key, f"phone:{len(area)}:{first}")
    lead, rest = divmod(value, 10 ** (len(area) - 1))
    return _refill(text, digits[:code] + first[lead] + (str(rest).zfill(len(area) - 1) if len(area) > 1 else ""))


SHAPED = {"email": email, "iban": iban, "ip": ip, "card": card, "ssn": ssn, "phone": phone}


def script(name: str) -> str:
    found = unicodedata.name(name[0], "LATIN").split(" ")[0]
    return found if found in SYLLABLES else "LATIN"


def name_parts(gender: str, text: str, at: int) -> list[tuple[int, int, str, str]]:
    """(start, end, class, normal form) of each name after a title that ends at a place: capitalised words up to the next title, with particles between them or before the first. The last is a family name, those before are given names of the title's gender."""
    parts = []
    while len(parts) < NAMES:
        m = NAME.match(text, at)
        while m and m[1] in PARTICLES:
            m = NAME.match(text, m.end())
        if not m or not m[1][0].isupper() or m[1].lower() in GENDER:
            break
        parts.append(m)
        at = m.end()
    out = []
    for i, m in enumerate(parts):
        role = "family:" if i == len(parts) - 1 else f"given:{gender}"
        out.append((*m.span(1), f"{role}:{script(m[1])}", m[1].lower()))
    return out


def name_surrogate(kind: str, name: str, attempt: int, key: bytes) -> str:
    """A made-up name of a class, in lower case. Later attempts are longer, so that any number of names finds its own."""
    role, gender, its = kind.split(":")
    syllables = SYLLABLES[its].split()
    value, n = _prf(key, kind, name, attempt), (2 if role == "given" else 3) + attempt
    out = ""
    for _ in range(n):
        value, at = divmod(value, len(syllables))
        out += syllables[at]
        if not value:
            value = _prf(key, kind, name, attempt, out)
    return out + ENDINGS[its][gender]


def emails(text: str):
    """Matches of the addresses of a text, each read back from its @, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        local = before[len(before.rstrip(LOCAL)) :].lstrip(MARKS)
        first = at - len(local)
        m = local and (RUN.match(text, at) and BEFORE_NEXT.match(text, first) or PATTERNS["email"].match(text, first))
        if m:
            yield m
        end = m.end() if m else at + 1
        at = text.find("@", end)


def find(text: str) -> list[tuple[int, int, str, object]]:
    """(start, end, kind, match) of a whole text's entities, in order, without overlaps."""
    found, names = [], {}
    digit = re.search("[0-9]", text, re.ASCII)
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        if "@" in text if kind == "email" else digit:
            found += [(m.start(), rank, m.end(), kind, m) for m in (emails(text) if kind == "email" else pattern.finditer(text))]
    for m in TITLE.finditer(text):
        if m[1][0].isupper() or ord(m[1][0]) > 127:
            for a, b, its, normal in name_parts(GENDER.get(m[1].lower(), ""), text, m.end()):
                found.append((a, len(PATTERNS), b, "person", normal))
                # A name that stands in two classes is a given name, of the first gender that it has.
                if normal not in names or (names[normal].startswith("family"), len(names[normal].split(":")[1])) > (its.startswith("family"), 1):
                    names[normal] = its
    if names:
        for m in MENTION.finditer(text):
            if m[0][0].isupper() and m[0].lower() in names:
                found.append((m.start(), len(PATTERNS) + 1, m.end(), "person", m[0].lower()))
    found.sort(key=lambda x: (x[0], x[1], -x[2]))
    out, end = [], 0
    for start, _, stop, kind, match in found:
        if start >= end:
            out.append((start, stop, kind, (names[match], match) if kind == "person" else match))
            end = stop
    return out


def _cased(name: str, like: str) -> str:
    return name.upper() if len(like) > 1 and like.isupper() else name.capitalize()


def rewrite(text: str, key: bytes, attempts: dict) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and the spans (in the text as it was)."""
    out, at, spans = [], 0, []
    for start, end, kind, match in find(text):
        own = text[start:end]
        new = _cased(name_surrogate(*match, attempts.get(match, 0), key), own) if kind == "person" else SHAPED[kind](own, key)
        out += [text[at:start], new]
        at = end
        spans.append((kind, start, end))
    return "".join([*out, text[at:]]), spans


def settled_names(docs: DataFrame, text_col: str, key: bytes) -> DataFrame:
    """(kind, name, attempt) of the names, of all documents, whose first surrogate is another's, or a name that stands in the documents: tried again until no two names of a class share one."""

    def run(batches):
        for batch in batches:
            names = {m for t in batch.column(0).to_pylist() if t for *_, kind, m in find(t) if kind == "person"}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in names], pa.string()), pa.array([n for _, n in names], pa.string())], names=["kind", "name"])

    def tried(batches):
        for batch in batches:
            made = [name_surrogate(k, n, a, key) for k, n, a in zip(*(batch.column(c).to_pylist() for c in ("kind", "name", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "name", "attempt", "made"])

    names = checkpointed(docs.select(text_col).mapInArrow(run, "kind string, name string").distinct().withColumn("attempt", F.lit(0)))
    real = names.select(F.col("name").alias("made")).distinct()
    while True:
        made = names.mapInArrow(tried, "kind string, name string, attempt int, made string")
        taken = made.join(real.withColumn("is_real", F.lit(True)), "made", "left")
        # Who came to a surrogate in fewer attempts keeps it; then the smaller name.
        turn = F.row_number().over(W.partitionBy("kind", "made").orderBy("attempt", "name"))
        again = F.col("is_real").isNotNull() | (F.col("turn") > 1)
        state = checkpointed(taken.withColumn("turn", turn).select("kind", "name", "attempt", again.alias("again")))
        if state.filter("again").isEmpty():
            return names.filter("attempt > 0")
        names = checkpointed(state.select("kind", "name", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")))


def session_key(spark) -> bytes:
    """The secret key that the session names in SURROGATE_KEY; where none is named, a random one for the application, so that surrogates can't be traced back, nor compared with those of another run."""
    if named := spark.conf.get(SURROGATE_KEY, None):
        return hashlib.blake2b(named.encode(), digest_size=32).digest()
    return _own_keys.setdefault(spark.sparkContext.applicationId, os.urandom(32))


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs as a struct `row` in which the text has surrogates, with `spans`: structs (kind, start, end) of the entities in the text as it was (code points, end exclusive).

    Emails, IBANs, IPv4 addresses, card, social-security and phone numbers go through a keyed permutation of all values of their shape, without fixed points: equal entities get equal surrogates everywhere, distinct ones distinct ones, checksums stay valid or invalid, separators, case and lengths stay. Names after a title get made-up ones of their script and gender, and so do their other mentions in the same text if they are capitalised: in a text, a name has one surrogate, in whatever role it stands. Names of all documents are checked for collisions, with each other and with names that occur, and tried again.
    key: secret (at most 64 bytes); whoever has it can trace surrogates back.
    Null texts stay null and have no spans; empty ones stay empty. Repeated rows and null ids are handled like any other. An empty table gives an empty one. Other columns are carried in `row`, whatever their names.
    """
    spark = docs.sparkSession
    again = settled_names(docs, text_col, key)
    rows = docs.select(F.struct("*").alias("row"))
    few = again.count() <= BROADCAST_NAMES
    known = spark.sparkContext.broadcast({(r["kind"], r["name"]): r["attempt"] for r in again.collect()} if few else {})
    if few:
        rows = rows.select("row", F.col("row")[text_col].alias("text"), F.lit(None).cast("array<struct<kind:string,name:string,attempt:int>>").alias("attempts"))
    else:

        def named(batches):
            for batch in batches:
                pairs = [(mark, *m) for mark, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in {m for *_, kind, m in find(t) if kind == "person"}]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["mark", "kind", "name"])

        marked = rows.withColumn("own", F.xxhash64(F.col("row")[text_col]))
        hits = marked.select(F.col("own"), F.col("row")[text_col].alias("text")).mapInArrow(named, "mark long, kind string, name string").distinct().join(again, ["kind", "name"])
        each = hits.groupBy("mark").agg(F.collect_set(F.struct("kind", "name", "attempt")).alias("attempts"))
        rows = marked.join(each, F.col("own") == F.col("mark"), "left").select("row", F.col("row")[text_col].alias("text"), "attempts")

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                attempts = {(a["kind"], a["name"]): a["attempt"] for a in own} if own else known.value
                new, where = rewrite(text, key, attempts) if text else (text, [])
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in where])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["row", "text", "spans"])

    kept = rows.schema["row"].dataType
    # The text travels once: the row goes without it.
    slim = rows.withColumn("row", F.struct(*[F.col("row")[f.name].alias(f.name) for f in kept if f.name != text_col], F.lit(0).alias("_")))
    done = slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, text string, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return done.select(F.struct(*[(F.col("text") if f.name == text_col else F.col("row")[f.name]).alias(f.name) for f in kept]).alias("row"), "spans")

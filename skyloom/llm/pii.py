"""Personal data replaced by keyed surrogates of the same type and form.

Found are e-mail addresses, IPv4 addresses, telephone, account and card numbers, social
security numbers, IBANs, secrets in hexadecimal, names that follow a form of address, and
every other mention of the words of such a name in the same text.

A surrogate is the image of the entity under a keyed permutation of all entities of the
same form. With P a Feistel network (keyed BLAKE2b rounds, cycle-walking to the size N of
the form), x goes to P'(P(x) + 1 mod N): a permutation that is one single cycle, hence
without fixed points. Where the form has a rule (Luhn or IBAN check digits, private
address ranges, numbers for invented telephones, known given names of a gender), the cycle
is followed to the next value that keeps the rule's outcome, which is a permutation of that
class again. So

* the same entity has the same surrogate in every document (coreference), without any
  table shared between tasks, whichever task is run again; a name is replaced word by word,
  and the class of a word depends on the word alone;
* different entities have different surrogates (distinctness): :func:`audit` checks the
  entities found for collisions and raises where it finds one.

Letters stay letters of the same script and case, digits digits, separators separators. In
names vowels stay vowels and consonants consonants. Given names known as male or female go
to given names of that gender and script; other names keep their last letter, which carries
gender in many languages.

The key is an argument without default. The query and the pipeline read it from the
session's ``spark.skyloom.pii.key``; where that is unset they draw a random one for the
application, so that nobody can turn surrogates back with what stands in the code.

A null text stays null and has no entities; repeated rows are treated alike; an empty
table gives an empty result; other columns are kept. Matching takes time in proportion to
the text, whatever its runs.
"""

from __future__ import annotations

import functools
import hashlib
import re
import secrets
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.text import read, tidy
from skyloom.plans.shared import materialize

NAME = "op3_pii_surrogates"
ORACLE_SQL = None  # keyed permutations; held against their properties instead

KEY = "spark.skyloom.pii.key"

# Given names by script and gender.
GIVEN = {
    ("latin", "m"): "james john robert michael william david richard thomas charles daniel matthew anthony mark paul steven andrew george edward peter henry hans klaus wolfgang jürgen stefan pierre jean louis michel philippe carlos jose juan miguel pablo".split(),
    ("latin", "f"): "mary anna linda susan karen nancy laura julia sarah elizabeth barbara jennifer margaret emily alice emma helen ruth martha jane sabine ursula monika heike petra marie claire sophie camille nathalie maria carmen lucia elena isabel".split(),
    ("cyrillic", "m"): "иван пётр сергей николай андрей дмитрий алексей михаил владимир павел юрий олег".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья ирина светлана татьяна юлия вера нина галина".split(),
    ("greek", "m"): "γιώργος δημήτρης νίκος κώστας ιωάννης παύλος".split(),
    ("greek", "f"): "μαρία ελένη κατερίνα βασιλική σοφία άννα".split(),
}
# Forms of address and the gender they tell.
ADDRESS = {"Mr.": "m", "Mr": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Dr.": "", "Prof.": "", "г-н": "m", "г-жа": "f"}
# Words that may stand between the parts of a name.
PARTICLES = set("von van der den de la del du di da dos zu af al el bin ibn".split())
# Alphabets in which a letter is exchanged for another, and their vowels.
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "accented": "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœß",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "greek": "αβγδεζηθικλμνξοπρςστυφχψωάέήίόύώ",
    "digit": "0123456789",
}
VOWELS = set("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœаеиоуыэюяёαεηιουωάέήίόύώ")
_SPLIT = {f"{name} {kind}": "".join(c for c in letters if (c in VOWELS) == (kind == "vowel")) for name, letters in ALPHABETS.items() if name != "digit" for kind in ("vowel", "other")}
_LETTERS = ALPHABETS | _SPLIT
_OF = {c: (name, k) for name, letters in ALPHABETS.items() for k, c in enumerate(letters)}
_OF_NAMES = {c: (name, k) for name, letters in _SPLIT.items() for k, c in enumerate(letters)}

_WORD = r"[^\W\d_]+(?:[-'’](?!s\b)[^\W\d_]+)*"
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<secret>(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z]))"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?P<gap>[ .-])\d{2,4}(?:(?P=gap)\d{2,4}){2,3}(?!\d|\.\d)|\+\d{8,15}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<account>(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d))"
    r"|(?P<name>(?<!\w)(?:" + "|".join(re.escape(x) for x in sorted(ADDRESS, key=len, reverse=True)) + r")(?=[ \t]+[^\W\d_]))"
)
#: The next part of a name: an initial with its full stop, or a word.
_PART = re.compile(r"[ \t]+(?:(?P<initial>[^\W\d_])\.(?P<more>(?:[^\W\d_]\.)*)|(?P<word>" + _WORD + "))")
_MENTION = re.compile(_WORD)
#: A text without any of these has no entity.
_HINTS = r"@|\d\.?\d|" + "|".join(re.escape(x) for x in ADDRESS)
_HINT = re.compile(_HINTS)


@functools.cache
def _alphabet(c: str) -> tuple[str, str]:
    """The name and the members of the alphabet of a letter or digit that no list above holds: its ten digits, or its kind in its block of 256."""
    if unicodedata.category(c) == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return f"digit{zero}", "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return "", ""
    kind, block = unicodedata.category(c), ord(c) >> 8 << 8
    return f"{kind}{block}", "".join(x for x in map(chr, range(block, block + 256)) if unicodedata.category(x) == kind and x.lower() == x and x not in _OF)


def _round(key: bytes, tweak: bytes, k: int, half: int, v: int) -> int:
    size = (half + 7) // 8
    out = b""
    while len(out) < size:
        out += hashlib.blake2b(v.to_bytes(size, "big") + bytes([k, len(out) // 64]), key=key[:64], person=hashlib.blake2b(tweak, digest_size=16).digest()).digest()
    return int.from_bytes(out[:size], "big") & ((1 << half) - 1)


def _feistel(x: int, size: int, key: bytes, tweak: bytes, back: bool) -> int:
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for k in range(7, -1, -1) if back else range(8):
            if back:
                left, right = right ^ _round(key, tweak, k, half, left), left
            else:
                left, right = right, left ^ _round(key, tweak, k, half, right)
        x = left << half | right
        if x < size:
            return x


def step(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """The next value on the keyed cycle through 0..size-1."""
    if size < 2:
        return x
    return _feistel((_feistel(x, size, key, tweak, False) + 1) % size, size, key, tweak, True)


def spell(text: str, key: bytes, tweak: bytes, same=lambda s: True, names: bool = False) -> str:
    """Another string of the same form; ``same`` tells whether a candidate is in the class of ``text``."""
    low = text.lower()
    if len(low) != len(text):
        low = text
    known, places = _OF_NAMES if names else _OF, []
    for k, c in enumerate(low):
        if c in known:
            name, digit = known[c]
            places.append((k, name, _LETTERS[name], digit))
        elif c.isalnum() and c not in _OF:
            name, letters = _alphabet(c)
            if c in letters:
                places.append((k, name, letters, letters.index(c)))
    if not places:
        return text
    size, x = 1, 0
    for _, _, letters, digit in places:
        size, x = size * len(letters), x * len(letters) + digit
    form = tweak + ",".join(name for _, name, _, _ in places).encode()
    while True:
        x = y = step(x, size, key, form)
        out = list(low)
        for k, _, letters, _ in reversed(places):
            y, digit = divmod(y, len(letters))
            out[k] = letters[digit]
        if same("".join(out)):
            break
    return "".join(o.upper() if c.isupper() and len(o.upper()) == 1 else o for c, o in zip(text, out))


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def iban_ok(text: str) -> bool:
    t = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _range(x: int) -> int:
    """Private and special address ranges, 0 for public ones."""
    a, b = x >> 24, x >> 16 & 255
    return 1 if a == 10 else 2 if a == 172 and 16 <= b < 32 else 3 if a == 192 and b == 168 else 4 if a == 127 else 5 if a == 0 or a >= 224 else 0


#: range: (first address, addresses) within which its cycle runs
_RANGES = {0: (0, 1 << 32), 1: (10 << 24, 1 << 24), 2: ((172 << 24) + (16 << 16), 1 << 20), 3: ((192 << 24) + (168 << 16), 1 << 16), 4: (127 << 24, 1 << 24), 5: (0, 1 << 32)}


def _email(v: str, key: bytes) -> str:
    local, _, domain = v.rpartition("@")
    labels = domain.split(".")
    fixed = 2 if labels[-2].lower() == "example" else 1
    return ".".join([spell(local, key, b"local") + "@" + spell(labels[0], key, b"domain"), *[spell(x, key, b"domain") for x in labels[1:-fixed]], *labels[-fixed:]]) if len(labels) > fixed else spell(local, key, b"local") + "@" + domain


def _ip(v: str, key: bytes) -> str:
    parts = [int(p) for p in v.split(".")]
    if max(parts) > 255:
        return spell(v, key, b"quad", lambda s: max(map(int, s.split("."))) > 255)
    x = int.from_bytes(bytes(parts), "big")
    low, size = _RANGES[_range(x)]
    y = x
    while True:
        y = low + step(y - low, size, key, b"ip%d" % _range(x))
        if _range(y) == _range(x):
            return ".".join(map(str, y.to_bytes(4, "big")))


def _invented(rest: str) -> tuple[int, int]:
    """Where the exchange 555 for invented numbers stands (-1: nowhere), and how many digits of 01 follow it."""
    at = rest.find("555")
    follow = "".join(c for c in rest[at + 3 :] if c.isdigit()) if at >= 0 else ""
    return at, 2 if len(follow) == 4 and follow.startswith("01") else 0


def _phone(v: str, key: bytes) -> str:
    """The country code, the exchange 555 and the line numbers 0100 to 0199 behind it are kept."""
    lead = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", v)
    head = lead.group() if lead else ""
    rest = v[len(head) :]
    at, more = form = _invented(rest)
    if at < 0:
        return head + spell(rest, key, b"phone" + head.encode(), lambda s: "555" not in s)
    held = [at, at + 1, at + 2]
    held += [k for k in range(at + 3, len(rest)) if rest[k].isdigit()][:more]
    hidden = "".join("\0" if k in held else c for k, c in enumerate(rest))
    back = lambda s: "".join(rest[k] if c == "\0" else c for k, c in enumerate(s))
    return head + back(spell(hidden, key, b"phone%d,%d" % form + head.encode(), lambda s: _invented(back(s)) == form))


@functools.lru_cache(1 << 14)
def name_word(word: str, key: bytes) -> str:
    """What replaces one word of a name, wherever it stands."""
    low = word.lower()
    for kind, names in GIVEN.items():
        if low in names:
            other = names[step(names.index(low), len(names), key, "".join(kind).encode())]
            return other.upper() if word.isupper() and len(word) > 1 else other.capitalize()
    keep = 1 if len(word) > 1 else 0  # the last letter, but not that of a single one
    end = word[len(word) - keep :]
    return spell(word[: len(word) - keep], key, b"name" + end.lower().encode(), lambda s: not any(s + end.lower() in n for n in GIVEN.values()), True) + end


def _name_parts(text: str, at: int, most: int = 3) -> list[tuple[int, int]]:
    """Where the words and initials of a name stand that starts behind a form of address."""
    spans: list[tuple[int, int]] = []
    passed = 0  # words between the parts
    while len(spans) < most and passed < most and (m := _PART.match(text, at)):
        at = m.end()
        if m["initial"]:
            if not m["initial"].isupper():
                break
            spans += [(k, k + 1) for k in range(m.start("initial"), at, 2)]
            continue
        word = m["word"]
        if word in ADDRESS or word + "." in ADDRESS and text[at : at + 1] == ".":
            break
        if word in PARTICLES:
            passed += 1
            continue
        cased = word[0].isupper()
        if not cased and (word[0].islower() or spans):
            break
        spans.append(m.span("word"))
        if not cased:
            break
    return spans


@functools.lru_cache(1 << 14)
def surrogate(kind: str, value: str, key: bytes) -> str:
    """What replaces an entity of this kind."""
    if kind == "email":
        return _email(value, key)
    if kind == "ip":
        return _ip(value, key)
    if kind == "phone":
        return _phone(value, key)
    if kind == "account":
        return value[0] + spell(value[1:], key, b"account" + value[0].encode(), lambda s: luhn(value[0] + s) == luhn(value))
    if kind == "iban":
        return value[:2] + spell(value[2:], key, b"iban" + value[:2].encode(), lambda s: iban_ok(value[:2] + s) == iban_ok(value))
    if kind == "secret":
        size = 16 ** len(value)
        new = f"{step(int(value, 16), size, key, b'secret%d' % len(value)):0{len(value)}x}"
        return new.upper() if value.upper() == value else new
    return spell(value, key, kind.encode())


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) in order."""
    if not _HINT.search(text):
        return text, []
    found, words, at = [], {}, 0  # found: (start, end, kind, surrogate)
    while m := _PATTERN.search(text, at):
        at = m.end()
        if m["name"] is None:
            kind = m.lastgroup if m.lastgroup != "gap" else "phone"
            found.append((m.start(), at, kind, surrogate(kind, m.group(), key)))
            continue
        spans = _name_parts(text, at)
        if not spans:
            continue
        new, done = [], m.start()
        for s, e in spans:
            word = text[s:e]
            other = name_word(word, key)
            new += [text[done:s], other]
            done = e
            if len(word) > 1:
                words[word], words[word.upper()] = other, other.upper()
        at = done
        found.append((m.start(), at, "name", "".join(new)))
    if words:
        gaps = zip([0, *(f[1] for f in found)], [*(f[0] for f in found), len(text)])
        found = sorted([*found, *(x for s, e in gaps for x in _mentions(text, s, e, words))])
    out, done = [], 0
    for s, e, _, new in found:
        out += [text[done:s], new]
        done = e
    return "".join([*out, text[done:]]), [(kind, text[s:e], new) for s, e, kind, new in found]


def _mentions(text: str, start: int, end: int, words: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """Other mentions of the words of names between two places, alone or as parts of a compound."""
    out = []
    for m in _MENTION.finditer(text, start, end):
        if m.group() in words:
            out.append((*m.span(), "name", words[m.group()]))
        elif not m.group().isalpha():
            out += [(*p, "name", words[text[p[0] : p[1]]]) for x in re.finditer(r"[^\W\d_]+", m.group()) if (p := (m.start() + x.start(), m.start() + x.end())) and x.group() in words]
    return out


def _replaced(key: bytes, with_entities: bool):
    def run(text: pa.Array) -> pa.Array:
        tidy()
        new, many, found = [], [], []
        for t in text:
            t = t.as_py()
            out, got = (None, []) if t is None else replace(t, key)
            new.append(out)
            many.append(len(got))
            found.append([{"kind": k, "entity": e, "surrogate": s} for k, e, s in got] if with_entities else None)
        cols, names = [pa.array(new, pa.string()), pa.array(many, pa.int64())], ["text", "n_entities"]
        if with_entities:
            cols.append(pa.array(found, pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "entity", "surrogate")]))))
            names.append("entities")
        del new, found
        tidy()
        return pa.StructArray.from_arrays(cols, names=names)

    return run


def surrogates(text: Column, key: bytes, with_entities: bool = False) -> Column:
    """A struct of the new ``text`` and ``n_entities``, with ``entities`` on demand."""
    if not key:
        raise ValueError("surrogates need a key")
    more = ",entities:array<struct<kind:string,entity:string,surrogate:string>>" * with_entities
    return F.arrow_udf(_replaced(key, with_entities), f"struct<text:string,n_entities:long{more}>")(text.cast("string"))


def entities(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, entity, surrogate) for each occurrence."""
    hinted = docs.where(F.col(text).cast("string").rlike("(?U)" + _HINTS))
    rows = hinted.select(F.col(doc_id).alias("doc_id"), surrogates(F.col(text), key, True).alias("x"))
    return rows.select("doc_id", F.explode("x.entities").alias("e")).select("doc_id", "e.*")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for several entities, entities with several surrogates, and surrogates of themselves: empty."""
    pairs = found.select("kind", F.lower("entity").alias("entity"), F.lower("surrogate").alias("surrogate")).distinct()
    pairs = materialize(pairs, "surrogates")
    many = lambda by, of: pairs.groupBy("kind", F.col(by).alias("value")).agg(F.count(of).alias("n")).where("n > 1")
    own = pairs.where("entity = surrogate").select("kind", F.col("entity").alias("value"), F.lit(1).cast("long").alias("n"))
    return many("surrogate", "entity").unionByName(many("entity", "surrogate")).unionByName(own)


def audit(docs: DataFrame, key: bytes, text: str = "text") -> None:
    """Raises if two entities of ``docs`` share a surrogate, or one has two."""
    found = entities(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), key)
    bad = collisions(found).limit(3).collect()
    if bad:
        raise RuntimeError(f"{len(bad)} or more collisions, of kinds {sorted({r['kind'] for r in bad})}")


@functools.cache
def _drawn(application: str) -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else a random one of the application."""
    return (spark.conf.get(KEY, None) or "").encode() or _drawn(spark.sparkContext.applicationId)


def replace_documents(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with new texts, checked for collisions; a column n_chars is set to their length."""
    audit(docs, key, text)
    taken = set(docs.columns)
    own = next(n for n in ("__x", "__x_", "__x__") if n not in taken)
    out = docs.withColumn(own, surrogates(F.col(text), key)).withColumn(text, F.col(f"{own}.text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = read(spark, sf_dir, "documents"), session_key(spark)
    audit(docs, key)
    return docs.select("doc_id", surrogates(F.col("text"), key).alias("x")).select("doc_id", "x.text", "x.n_entities")

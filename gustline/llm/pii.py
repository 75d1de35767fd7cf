"""Personal data replaced by surrogates.

Entities are found by pattern and reduced to what names them (an address in
small letters, the digits of a number, each part of a name).  A name is known by
its title or by a given name of the lists before it, and then wherever else its
parts stand in the document.  Every distinct one
gets a surrogate from a keyed hash: of the same kind, script, gender and form,
never one that the corpus itself holds, and never one that another entity has.
Both are checked over all entities, and whatever collides draws again, until
nothing does; so mentions of one entity stay one, and of two stay two.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.rows import shield, text_key, text_keys
from gustline.llm.staging import Staging
from gustline.llm.words import longs, text_bytes

# Titles and what gender they tell, and given names and surnames by gender and script.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "господин": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "госпожа": "f", "Госпожа": "f",
    "Dr": "n", "Prof": "n",
}
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leon Marco Noah Oscar Paul Robert Simon",
    ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sara",
    ("n", "latin"): "Alex Andrea Ariel Charlie Dominique Eden Jamie Kim Luca Morgan Noel Robin Sam Sascha Toni Val",
    ("m", "cyrillic"): "Андрей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Максим Николай Олег Павел",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Ирина Мария Надежда Ольга Полина Софья",
    ("n", "cyrillic"): "Саша Женя Валя Никита Слава Шура",
}
SURNAMES = {
    "latin": "Abel Baker Castor Dorn Ebert Fischer Garnier Hobbs Ibarra Jansen Keller Lange Mercer Noble Ortega Palmer "
    "Quinn Rossi Sommer Tanner Ulrich Vance Weber Young Ziegler",
    "cyrillic": "Абрамов Белов Власов Громов Дроздов Ершов Жуков Зимин Ильин Комаров Лосев Морозов",
}

TITLES |= {title.upper(): gender for title, gender in TITLES.items()}
#: Given names of the lists and what gender they tell; one of several lists tells none.
KNOWN_GIVEN: dict[str, str] = {}
for (_gender, _), _names in GIVEN.items():
    for _name in _names.split():
        for _form in (_name, _name.upper()):
            KNOWN_GIVEN[_form] = _gender if KNOWN_GIVEN.get(_form, _gender) == _gender else "n"


def _class(*tests) -> str:
    """A character class of the letters that pass a test, by ranges."""
    ranges: list[list[int]] = []
    for x in range(0x10000):
        if any(test(chr(x)) for test in tests):
            if ranges and ranges[-1][1] == x - 1:
                ranges[-1][1] = x
            else:
                ranges.append([x, x])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]"


_UPPER = _class(lambda c: unicodedata.category(c) in ("Lu", "Lt"))
_LOWER = _class(lambda c: unicodedata.category(c) in ("Ll", "Mn"))
_MIXED = rf"(?:{_UPPER}['’])?{_UPPER}{_LOWER}+(?:['’]?{_UPPER}{_LOWER}+)*"
_CAPITALS = rf"(?:{_UPPER}['’])?{_UPPER}{{2,}}(?:['’]{_UPPER}+)*"
_NAME = rf"(?:{_MIXED}|{_CAPITALS})(?!\w)"
_INITIALS = rf"(?:{_UPPER}\.[ -]?|{_UPPER} )+"
_PARTICLES = "(?:(?:von|vom|van|de|der|den|del|della|di|da|dos|du|la|le|zu|zur|ter|ten|af|av|al|el|bin|ibn) )*"
_WORD = rf"(?:{_INITIALS})?{_PARTICLES}{_NAME}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds in the order in which they take their spans.
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "card": re.compile(r"(?<![\w.-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![\w-])|(?<![\w.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w.+-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)"
        r"|(?<![\w.+-])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)"
    ),
    "ip": re.compile(rf"(?<![\w.-]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.[0-9])"),
    "ipv6": re.compile(
        r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?=(?:[0-9A-Fa-f]*:){3})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
    ),
    "birth": re.compile(
        r"(?i:\b(?:born|dob|d\.o\.b\.|date of birth|birth date|geboren|né|née|nacid[oa]|родил(?:ся|ась))"
        r"(?: on| am| le| el)?:? {0,2})([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?!\w)"
    ),
    "person": re.compile(rf"(?<!\w)({'|'.join(TITLES)})\.? ({_WORD}(?:[ -]{_WORD}){{0,2}})"),
}
#: A given name of the lists, further ones, and a surname.
_GIVEN = "|".join(sorted(KNOWN_GIVEN, key=len, reverse=True))
_UNTITLED = re.compile(rf"(?<!\w)(?=[A-ZА-ЯЁ])({_GIVEN})((?:[ -](?:{_GIVEN}))* {_WORD}(?:-{_NAME})?)")
_PART = re.compile(rf"(?P<initial>{_UPPER}(?![\w'’]))|(?P<name>(?<!\w){_NAME})")
#: What a text has at least if a pattern of digits matches, its words, and those that some name needs.
_NUMBERS = re.compile(r"[0-9][0-9 .()/-]{5,}[0-9]|\+[0-9]|[A-Z]{2}[0-9]{2}|[0-9A-Fa-f]:[0-9A-Fa-f:]+:")
_WORDS = re.compile(r"[^\W\d_]+")
_TELLING = frozenset(TITLES) | frozenset(KNOWN_GIVEN)
#: Bits of the field that tells which texts have mentions; more only saves joined rows.
FIELD_BITS = 25
_DIGITS = re.compile(r"[^0-9]")


def _script(part: str) -> str:
    """The script of a name's first letter, as Unicode names it: latin, cyrillic, greek and so on."""
    return unicodedata.name(part[0], "latin").split()[0].lower()


def name_value(part: str) -> str:
    """What names a part of a name, whatever its capitals."""
    part = unicodedata.normalize("NFC", part)
    return part[0] + part[1:].lower()


def _name_parts(text: str, start: int, end: int, gender: str) -> Iterator[tuple[int, int, str, str]]:
    """The parts of the name in a span: the last is the surname; an initial is told with its surname."""
    found = list(_PART.finditer(text, start, end))
    named = [m for m in found if m["name"]]
    last = named[-1] if named else None
    # a surname may be double, with a hyphen between
    surnames = set()
    for m, after in zip(named[::-1], [None, *named[::-1]]):
        if after is not None and text[m.end() : after.start()] != "-":
            break
        surnames.add(m.start())
    for m in found:
        script = _script(m[0])
        if m["initial"]:
            yield *m.span(), f"initial_{script}", f"{m[0]} {name_value(last[0])}" if last else m[0]
        else:
            role = "surname" if m.start() in surnames else f"given_{gender}"
            yield *m.span(), f"{role}_{script}", name_value(m[0])


def find(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and value of the entities in a text, without overlap; a name gives one for each part.

    What is known as part of a name from its title, or from a listed given name before it, is one in all of the text.
    """
    taken: list[tuple[int, int]] = []
    found = []
    known: dict[str, str] = {}

    def free(start: int, end: int) -> bool:
        if any(s < end and start < e for s, e in taken):
            return False
        taken.append((start, end))
        return True

    def add_name(start: int, end: int, gender: str) -> None:
        for entity in _name_parts(text, start, end, gender):
            found.append(entity)
            if not entity[2].startswith("initial"):
                known.setdefault(entity[3], entity[2])

    numbers, names = _NUMBERS.search(text), not _TELLING.isdisjoint(_WORDS.findall(text))
    wanted = {"email": "@" in text, "person": names}
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text) if wanted.get(kind, numbers) else ():
            start, end = m.span()
            if not free(start, end):
                continue
            if kind == "person":
                add_name(*m.span(2), TITLES[m[1]])
            elif kind == "email":
                found.append((start, end, kind, m[0].lower()))
            elif kind in ("ip", "ipv6"):
                found.append((start, end, kind, m[0].lower()))
            elif kind == "birth":
                found.append((*m.span(1), kind, m[1]))
            elif kind == "iban":
                found.append((start, end, kind, m[0].replace(" ", "")))
            else:
                found.append((start, end, kind, _DIGITS.sub("", m[0])))
    for m in _UNTITLED.finditer(text) if names else ():
        if free(*m.span()):
            add_name(*m.span(), KNOWN_GIVEN[m[1]])
    if known:
        initials: list[re.Match] = []
        for m in _PART.finditer(text):
            if m["initial"]:
                initials = [i for i in initials if m.start() - i.end() <= 2] + [m]
                continue
            kind = known.get(name_value(m[0]))
            if kind and free(*m.span()):
                found.append((*m.span(), kind, name_value(m[0])))
                # initials right before a surname that is known
                at = m.start()
                for i in reversed(initials if kind.startswith("surname") else []):
                    if text[i.end() : at].strip(". -") or at - i.end() > 2 or not free(*i.span()):
                        break
                    found.append((*i.span(), f"initial_{_script(i[0])}", f"{i[0]} {name_value(m[0])}"))
                    at = i.start()
            initials = []
    return sorted(found)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


class _Draw:
    """Numbers from a keyed hash of kind, value and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = f"{kind}\0{value}\0{attempt}".encode()
        self.key, self.pool, self.turn = key, 0, 0

    def below(self, n: int) -> int:
        if self.pool < n << 32:
            block = hmac.digest(self.key, self.seed + self.turn.to_bytes(4, "big"), hashlib.sha256)
            self.pool, self.turn = int.from_bytes(block, "big"), self.turn + 1
        self.pool, out = divmod(self.pool, n)
        return out

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """A value of the kind, of the same form, that the key, the value and the attempt decide."""
    draw = _Draw(key, kind, value, attempt)
    if kind == "email":
        name, _, domain = value.partition("@")
        host, dot, top = domain.rpartition(".")
        return "".join(map(lambda c: _like(c, draw), name)) + "@" + "".join(map(lambda c: _like(c, draw), host)) + dot + top
    if kind == "card":
        body = value[0] + draw.digits(len(value) - 1)
        if _luhn(value) == 0:
            return body[:-1] + str((10 - _luhn(body[:-1] + "0")) % 10)
        return body if _luhn(body) else body[:-1] + str((int(body[-1]) + 1) % 10)
    if kind == "ssn":
        return "9" + draw.digits(8)
    if kind == "phone":
        rest = min(10, len(value) - 1)
        body = draw.digits(rest)
        if rest == 10 and value[-7:-4] == "555":
            body = str(2 + draw.below(8)) + body[1:3] + "555" + body[6:]
        return value[: len(value) - rest] + body
    if kind == "ip":
        parts = value.split(".")
        private = {"10": 1, "127": 1, "192": 2 * (parts[1] == "168"), "172": 2 * (16 <= int(parts[1]) < 32)}.get(parts[0], 0)
        fresh = [str(1 + draw.below(223)), *[str(draw.below(256)) for _ in range(3)]]
        return ".".join([*parts[:private], *fresh[private:]])
    if kind == "iban":
        body = "".join(_like(c, draw) for c in value[4:])
        number = "".join(str(int(c, 36)) for c in body + value[:2]) + "00"
        return f"{value[:2]}{98 - int(number) % 97:02d}{body}"
    if kind == "ipv6":
        return ":".join("".join("0123456789abcdef"[draw.below(16)] for _ in group) for group in value.split(":"))
    if kind == "birth":
        # another day and month, and a year near it, in the same order and of the same widths
        fields = re.split(r"([./-])", value)
        for i in range(0, len(fields), 2):
            year = len(fields[i]) == 4
            number = int(fields[i]) - 5 + draw.below(11) if year else 1 + draw.below(12 if i == 2 else 28)
            fields[i] = str(number).zfill(4 if year else 2)
        return "".join(fields)
    role, *gender, script = kind.split("_")
    if script not in SURNAMES:  # no names of this script are known: letters of it, as many as there were
        return "".join(_of_script(c, draw) for c in value) + "".join(_of_script(value[-1], draw) for _ in range(attempt // 3))
    names = (SURNAMES[script] if role == "surname" else GIVEN[gender[0], script]).split()
    name = names[draw.below(len(names))]
    # beyond the list, names are joined with others, more of them the more often a draw has collided
    for _ in range((attempt + 2) // 3):
        name += names[draw.below(len(names))].lower()
    return name


def _like(c: str, draw: _Draw) -> str:
    if c.isdigit():
        return str(draw.below(10))
    if "a" <= c <= "z":
        return chr(97 + draw.below(26))
    if "A" <= c <= "Z":
        return chr(65 + draw.below(26))
    if c.isalpha():
        other = "àáâèéêìíòóùúäöüñç" if ord(c) < 0x250 else "абвгдежзиклмнопрст" if 0x400 <= ord(c) < 0x500 else ""
        # letters of other scripts give way to their neighbours
        other = other or [x for x in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if x.isalpha()]
        return other[draw.below(len(other))]
    return c


#: Letters that their scripts no longer write.
_OUT_OF_USE = {"STIGMA", "DIGAMMA", "KOPPA", "SAMPI", "SHO", "SAN", "YOT", "HETA", "PAMPHYLIAN"}


def _alphabet(c: str) -> list[str]:
    """The plain letters of a letter's script and case that are near it."""
    kind, script = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]
    near = map(chr, range(ord(c) & ~63, (ord(c) & ~63) + 64))
    names = [(x, unicodedata.name(x, "").split(" ")) for x in near if unicodedata.category(x) == kind]
    return [x for x, n in names if n[0] == script and len(n) <= 4 and n[-1] not in _OUT_OF_USE]


def _of_script(c: str, draw: _Draw) -> str:
    """Another letter of the same script and case."""
    others = _alphabet(c)
    return others[draw.below(len(others))] if others else c


def _like_initial(key: bytes, kind: str, value: str) -> str:
    """Another initial; those of one surname stay distinct, as its letters are dealt anew for it as a whole."""
    letter, _, surname = value.partition(" ")
    draw = _Draw(key, "initial", surname, 0)
    letters = _alphabet(letter)
    if letter not in letters:  # one with an accent, say: beyond those that are dealt
        letters.append(letter)
    dealt = list(letters)
    for i in range(len(dealt) - 1, 0, -1):
        j = draw.below(i + 1)
        dealt[i], dealt[j] = dealt[j], dealt[i]
    return dealt[letters.index(letter)]


def render(mention: str, kind: str, value: str) -> str:
    """A surrogate in the form of a mention: its separators and capitals."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(value)
        return "".join(next(left, "") if c.isalnum() else c for c in mention)
    if kind == "email" and mention.isupper():
        return value.upper()
    if kind.startswith(("given", "surname")) and len(mention) > 1 and mention.isupper():
        return value.upper()
    if kind == "email":
        return "".join(v.upper() if c.isupper() else v for c, v in zip(mention, value)) + value[len(mention) :]
    return value


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), start, end, kind, value and mention of every entity; spans in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for start, end, kind, value in find(text):
                    owner.append(i)
                    rows.append((start, end, kind, value, text[start:end]))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            at = pa.array(np.array(owner, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("digest").take(at)]
                + [pa.array(list(c), t) for c, t in zip(columns, types)],
                ["doc_id", "digest", "start", "end", "kind", "value", "mention"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_key().alias("digest"), "text").filter("text is not null").mapInArrow(
        run, f"doc_id {kind}, digest long, start int, end int, kind string, value string, mention string"
    )


def one_gender(entities: DataFrame) -> DataFrame:
    """kind, value and resolved of distinct entities: a given name has one kind, whatever titles it has been met with.

    Titles of one gender decide; where there are none, or of both, it has none.
    """
    given = r"^given_([mfn])_(\w+)$"
    named = entities.filter(F.col("kind").rlike(given)).select(
        F.regexp_extract("kind", given, 2).alias("script"), "value", F.regexp_extract("kind", given, 1).alias("gender")
    )
    told = F.collect_set(F.when(F.col("gender") != "n", F.col("gender")))
    genders = named.groupBy("script", "value").agg(told.alias("told"))
    one = F.when(F.size("told") == 1, F.get("told", F.lit(0))).otherwise("n")
    genders = genders.select("script", "value", F.concat(F.lit("given_"), one, F.lit("_"), F.col("script")).alias("one"))
    script = F.when(F.col("kind").rlike(given), F.regexp_extract("kind", given, 2))
    return entities.withColumn("script", script).join(genders, ["script", "value"], "left").select(
        "kind", "value", F.coalesce("one", "kind").alias("resolved")
    )


def assign(entities: DataFrame, key: bytes, staging: Staging) -> DataFrame:
    """kind, value and surrogate of distinct entities; surrogates are distinct and none is an entity.

    Each round draws for what is still open, and keeps a draw unless it is an entity's own value, is taken, or is wanted
    by another of smaller value.  Rounds end when nothing is open.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, attempt = batch.column("kind"), batch.column("value"), batch.column("attempt")
            drawn = [surrogate(key, k, v, a) for k, v, a in zip(*(c.to_pylist() for c in (kinds, values, attempt)))]
            yield pa.RecordBatch.from_arrays([kinds, values, pa.array(drawn, pa.string())], ["kind", "value", "surrogate"])

    def kind(c: str):  # names of any role or gender must not be taken for each other
        return F.when(F.col(c).rlike("^(given|surname)"), F.lit("name")).otherwise(F.col(c))

    own = entities.select(kind("kind").alias("sort"), F.col("value").alias("surrogate")).distinct()
    done, left, turn = None, entities, 0
    while True:
        drawn = left.withColumn("attempt", F.lit(turn)).mapInArrow(draw, "kind string, value string, surrogate string")
        drawn = staging.table(drawn.withColumn("sort", kind("kind")), f"drawn-{turn}")
        free = drawn.join(own, ["sort", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("sort", "surrogate"), ["sort", "surrogate"], "left_anti")
        best = free.groupBy("sort", "surrogate").agg(F.min(F.struct("value", "kind")).alias("best"))
        kept = staging.table(best.select("best.kind", "best.value", "surrogate", "sort"), f"kept-{turn}")
        done = kept if done is None else done.unionByName(kept)
        left = drawn.select("kind", "value").join(kept.select("kind", "value"), ["kind", "value"], "left_anti")
        left = staging.table(left, f"left-{turn}")
        if left.isEmpty():
            return done.select("kind", "value", "surrogate")
        turn += 1


def _field(found: DataFrame):
    """The bits that the digests of texts with mentions set; at most 2 ** FIELD_BITS / 64 rows reach the driver."""
    slot = F.col("digest").bitwiseAND(F.lit((1 << FIELD_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(digest & 63L as int))")
    words = found.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    field[words["word"].to_numpy()] = words["bits"].to_numpy()
    return found.sparkSession.sparkContext.broadcast(field.view(np.uint64))


def _with_key(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with _key, the digest of the text, and _maybe: false only where the text has no mention."""
    sent = _field(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            keys = text_keys(*text_bytes(batch.column("text")))
            slot = keys & np.uint64((1 << FIELD_BITS) - 1)
            maybe = (field[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            yield batch.append_column("_key", longs(keys)).append_column("_maybe", pa.array(maybe.astype(bool)))

    fields = [*docs.schema.fields, T.StructField("_key", T.LongType()), T.StructField("_maybe", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType(fields))


def replace(docs: DataFrame, key: bytes, staging: Staging | None = None) -> DataFrame:
    """The rows of ``docs`` with entities in ``text`` replaced, and n_entities and spans (kind:start:end in the old text).

    Reads ``doc_id`` and ``text`` and keeps the other columns, of any name but n_entities and spans, which are
    replaced.  A null text stays null, an empty one empty, both without entities.
    Of overlapping matches the kind listed first in PATTERNS stands.  Repeated rows are treated alike.  The same key
    gives the same surrogates for the same entities.  An empty table gives no rows.
    """
    staging = staging or Staging(docs.sparkSession)
    found = staging.table(mentions(docs), "mentions")
    entities = staging.table(one_gender(found.filter("kind not like 'initial%'").select("kind", "value").distinct()), "entities")
    names = assign(entities.select(F.col("resolved").alias("kind"), "value").distinct(), key, staging)
    names = entities.join(names.withColumnRenamed("kind", "resolved"), ["resolved", "value"])
    names = staging.table(names.select("kind", "value", "resolved", "surrogate"), "surrogates")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("mention", "kind", "surrogate", "value")))
            # an initial stands for many names, so it has no surrogate of its own
            drawn = [(m, k, _like_initial(key, k, v) if k.startswith("initial") else x) for m, k, x, v in cells]
            new = pa.array([render(*c) for c in drawn], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], new], ["doc_id", "digest", "start", "end", "kind", "new"]
            )

    id_type = dict(docs.dtypes)["doc_id"]
    edits = found.join(names, ["kind", "value"], "left").select(
        "doc_id", "digest", "start", "end", F.coalesce("resolved", "kind").alias("kind"), "mention", "surrogate", "value"
    )
    edits = edits.mapInArrow(rendered, f"doc_id {id_type}, digest long, start int, end int, kind string, new string")
    listed = edits.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind", "new"))).alias("_edits")
    )
    base, restore = shield(docs.drop("n_entities", "spans"), "doc_id", "text")
    keep = [F.col(c) for c in base.columns if c != "text"]
    none = F.array().cast("array<struct<start:int,end:int,kind:string,new:string>>")
    keyed = _with_key(base, found)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest"))
    some = keyed.filter("_maybe").join(listed, same, "left")
    some = some.withColumn("_edits", F.coalesce("_edits", none))
    # what stands between edits, and the edits, in turn
    gaps = F.transform(
        F.col("_edits"),
        lambda e, i: F.concat(
            F.substr("text", F.when(i == 0, F.lit(0)).otherwise(F.get("_edits", i - 1)["end"]) + 1,
                     e["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("_edits", i - 1)["end"])),
            e["new"],
        ),
    )
    end = F.coalesce(F.get("_edits", F.size("_edits") - 1)["end"], F.lit(0))
    tail = F.substr("text", end + 1, F.length("text"))
    text = F.concat(F.array_join(gaps, ""), tail)
    spans = F.array_join(
        F.transform("_edits", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ","
    )
    edited = some.select(*keep, text.alias("text"), F.size("_edits").cast("long").alias("n_entities"), spans.alias("spans"))
    rest = keyed.filter("not _maybe").select(
        *keep, "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("spans")
    )
    return edited.unionByName(rest).select(*restore, "n_entities", "spans")

"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

1. A scan finds mentions: e-mail addresses, secrets after a key word, in a bearer header or in a url's login, keys of well-known form, IBANs, IPv4 and IPv6 addresses, social security,
   phone, card and account numbers, and names after an honorific. A name is read token by token: words in capitals or in a script without case, initials, and particles, which stay. Its words are entities
   of their own: given names, and the family name, which all genders share. Once a text names a person, the same words without an honorific are mentions too; a possessive is not part of
   the name. A mention's canonical form (digits only for numbers, without country code or trunk zero for phones, lower case elsewhere) is the entity: all mentions of it, in all documents, are the same one
   (coreference). A given name has the gender of its honorifics over all mentions, if they agree.
2. The distinct entities get a surrogate by a keyed hash: every letter becomes a letter of its script, every digit a digit. Country codes,
   separators, the last part of a domain and a key's prefix stay, card numbers and IBANs stay valid, names stay pronounceable and given names keep their gender's ending.
3. Collision check: entities whose surrogate equals another entity's or any real entity draw again (all but the one with the fewest draws), until
   none is left; given names of all genders are one space. Every ``GROW`` draws the surrogate gets longer, so a shape with fewer surrogates than entities (two-letter names, say) is left and the draws end.
   An initial is one letter drawn from itself and its family name; initials need not differ.
4. Each mention is rendered in its own format and case. Texts without mentions are not shuffled.

Not found: names without any honorific in their text, street addresses, dates. A known name's word is replaced wherever it is capitalised in its text.

Nulls: a null text comes back null if the column is read as it is, and has no entities. Repeated rows get the same replacements. Empty tables and extra columns, whatever
their names, are fine: all columns are returned as they are, but for the text; a column ``n_entities`` of the input gives way to the count.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import key_bitmap, packed, table, text_of, with_flag

# Honorifics by gender.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña")
EITHER = ("Dr", "Prof", "Doctor", "Professor", "Doktor")

HONORIFICS = frozenset(MALE + FEMALE + EITHER)
# Particles of family names, and the calling codes of one and two digits (all others have three).
PARTICLES = frozenset("von van de der den des la las los le del della di da du do dos das zu zum zur ten ter te y e af av al el bin ibn".split())
ONE, TWO = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
PATTERNS = {
    "login": r"://[^\s:/@]++:([^\s:/@]++)@",
    "email": r"(?<![\w.%+-])[._%+-]*+([^\W_][\w.%+-]*+@[\w-]++(?:\.[\w-]++)+)",
    "bearer": r"(?i:\bbearer[ ]++)([A-Za-z0-9._~+/=-]{16,})",
    "secret": r"(?i:\b(?:token|api[_-]?key|secret|password|passwd|pwd)\b\s*+[=:]\s*+[\"']?)([^\s\"']{8,})",
    "key": r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?)(?![A-Za-z0-9_-])",
    "iban": r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ipv6": r"(?<![\w:.])((?=[0-9A-Fa-f]*+:)[0-9A-Fa-f:]{3,39}+)(?![\w.])",
    "ip": r"(?<![\d.])((?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\d]|\.\d)",
    "ssn": r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])",
    "phone": r"(\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d))",
    "national": r"(?<![\w.+-])(\d{3}([ .-])\d{3}\2\d{4})(?![\w-])",
    "trunk": r"(?<![\w.+-])(0\d([ .-])\d{2}\2\d{2}\2\d{2}\2\d{2}|0\d{2,4}[ /-]\d{3,4} ?\d{2,4})(?![\w-]|[.,]\d)",
    "number": r"(?<![\w.])(\d(?:[ -]?\d){12,18})(?!\w)",
    "name": rf"\b(?:{'|'.join(MALE + FEMALE + EITHER)})(?:\.[ \u00a0]?|[ \u00a0])",
}
#: Patterns that find more of another kind.
KIND = {"national": "phone", "trunk": "phone", "bearer": "secret", "login": "secret"}
_FIND = {kind: re.compile(p) for kind, p in PATTERNS.items()}
_WORD = re.compile(NAME)
# Every match of a pattern has one of these strings, so texts without them need no search for it; patterns that are not listed are always searched.
NEEDS = {
    "email": ("@",), "login": ("://",), "bearer": ("earer", "EARER"), "secret": ("=", ":"), "ipv6": (":",), "ip": (".",), "ssn": ("-",), "phone": ("+", "("), "trunk": ("0",), "name": MALE + FEMALE + EITHER,
    "key": ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza", "eyJ"),
}
GROW = 8

# Letters by script, consonants and vowels.
LETTERS = {"latin": ("bcdfghklmnprstvz", "aeiou"), "greek": ("βγδζθκλμνπρστφχ", "αεηιο"), "cyrillic": ("бвгдзклмнпрстфх", "аеиоу")}
GIVEN = ("male", "female", "given")
NAMES = (*GIVEN, "family")


def _ipv6(mention: str) -> ipaddress.IPv6Address | None:
    try:
        return ipaddress.IPv6Address(mention)
    except ValueError:
        return None


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _national(digits: str, abroad: bool) -> str:
    """A phone number without calling code and trunk zero, the same from home and from abroad."""
    if abroad:
        digits = digits[1 if digits[0] in ONE else 2 if digits[:2] in TWO else 3 :]
    return digits[1:] if digits.startswith("0") and len(digits) > 1 else digits


def canonical(kind: str, mention: str) -> str | None:
    """The entity that a mention stands for; None if the mention is none."""
    if kind in ("phone", "number", "ssn"):
        digits = "".join(c for c in mention if c.isdigit())
        return _national(digits, mention.startswith("+")) if kind == "phone" else digits
    if kind == "initial":
        return mention
    if kind == "iban":
        plain = mention.replace(" ", "")
        return plain if _iban_rest(plain) == 1 else None
    if kind == "ipv6":
        at = _ipv6(mention)
        return at and at.compressed
    return mention if kind in ("secret", "key") else mention.lower()


def _begins_name(word: str) -> bool:
    """Whether it is written in capitals, or in a script without case."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def _bare(text: str, a: int, b: int) -> int:
    """The end of a word without its possessive."""
    return b - 2 if b - a > 3 and text[b - 2] in "'’" and text[b - 1] == "s" else b


def _words_of_name(text: str, at: int, gender: str) -> tuple[list[tuple[int, int, str, str | None]], int]:
    """(start, end, kind, entity) of the words of the name at ``at``, and where it ends. Given names, then the family name; the entity of an initial is set, the others follow from their text."""
    words, initials, end = [], [], at
    while m := _WORD.match(text, at):
        a, b = m.span()
        word, nxt = m[0], text[m.end() : m.end() + 1]
        spaced = nxt in (" ", "\u00a0") and nxt != ""
        if len(word) == 1 and word.isupper() and (nxt == "." or spaced):
            initials.append((a, b))
            at = b + (nxt == ".")
            at += text[at : at + 1] in (" ", "\u00a0") and at < len(text)
            continue
        if word.lower() in PARTICLES and spaced:
            at = b + 1
            continue
        if not _begins_name(word) or word in HONORIFICS:
            break
        short = _bare(text, a, b)
        words.append((a, short))
        end = b
        if short < b or not spaced:
            break
        at = b + 1
    if not words or (len(words) == 1 and words[0][1] - words[0][0] < 2 and text[words[0][0]].isupper()):
        return [], at
    family = text[slice(*words[-1])].lower()
    out = [(a, b, gender, None) for a, b in words[:-1]] + [(*words[-1], "family", None)]
    return out + [(a, b, "initial", f"{text[a].lower()}.{family}") for a, b in initials if a < end], end


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity), without overlaps; patterns go first in their order, then words of known names."""
    found, taken = [], bytearray(len(text))

    def take(a: int, b: int, kind: str, entity: str | None = None) -> None:
        entity = entity or canonical(kind, text[a:b])
        if entity and taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind, entity))

    for name, pattern in _FIND.items():
        if name in NEEDS and not any(c in text for c in NEEDS[name]):
            continue
        if name != "name":
            for m in pattern.finditer(text):
                take(*m.span(1), KIND.get(name, name))
            continue
        at = 0
        while m := pattern.search(text, at):
            honorific = m[0].rstrip(" .\u00a0")
            gender = "male" if honorific in MALE else "female" if honorific in FEMALE else "given"
            words, end = _words_of_name(text, m.end(), gender)
            for word in words:
                take(*word)
            at = max(m.end(), end if words else m.end())
    known = {}
    for _, _, kind, entity in found:
        if kind in NAMES:
            known.setdefault(entity, kind)
    if known:
        for m in _WORD.finditer(text):
            a, b = m.start(), _bare(text, *m.span())
            if m[0][0].isupper() and text[a:b].lower() in known:
                take(a, b, known[text[a:b].lower()])
        caseless = {e for e in known if len(e) > 1 and e[0].upper() == e[0]}
        for size in {len(e) for e in caseless}:  # such scripts may run words together
            for a in range(len(text) - size + 1):
                if text[a : a + size] in caseless:
                    take(a, a + size, known[text[a : a + size]])
    return sorted(found)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _stream(key: bytes, kind: str, entity: str, attempt: int) -> Iterator[int]:
    n = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{entity}\0{attempt}\0{n}".encode(), key=key, digest_size=64).digest()
        n += 1


def _script(c: str) -> str | None:
    if "\u0370" <= c <= "\u03ff":
        return "greek"
    if "\u0400" <= c <= "\u04ff":
        return "cyrillic"
    return "latin" if c < "\u0250" else None


def _longer(kind: str, entity: str, more: int) -> str:
    """``entity`` with ``more`` places for letters or digits added where its type allows them."""
    if kind == "email":
        return entity.replace("@", "a" * more + "@", 1)
    if kind in NAMES:
        return entity[:-1] + entity[-1] * (more + 1)
    return entity + ("0" if kind in ("phone", "number", "ssn", "iban") else "a") * more


def _address(draw: Iterator[int], kind: str, entity: str, grow: int) -> str:
    number = lambda n: int.from_bytes(bytes(next(draw) for _ in range(n)), "big")
    if kind == "ip" and not grow:  # parts of the same lengths
        return ".".join(str(1 + next(draw) % 9) + "".join(str(next(draw) % 6) for _ in part[1:]) if len(part) < 3 else "1" + "".join(str(next(draw) % 10) for _ in part[1:]) for part in entity.split("."))
    if kind == "ip" and grow < 3:
        return str(ipaddress.IPv4Address(number(4)))
    if kind == "ip" or grow:
        return str(ipaddress.IPv6Address((0x20010DB8 << 96) + number(12)))
    groups = ipaddress.IPv6Address(entity).exploded.split(":")
    return str(ipaddress.IPv6Address(":".join("0" if not int(g, 16) else format(1 + number(4) % (16 ** len(g.lstrip("0")) - 1), "x") for g in groups)))


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """A canonical form of the same type and scripts as ``entity``, and of its length in the first ``GROW`` attempts."""
    draw, grow = _stream(key, "given" if kind in GIVEN else kind, entity, attempt), attempt // GROW
    if kind == "initial":
        letters = "".join(LETTERS[_script(entity[0]) or "latin"])
        return letters[next(draw) % len(letters)]
    if kind in ("ip", "ipv6"):
        return _address(draw, kind, entity, grow)
    entity = _longer(kind, entity, 2 * grow)
    keep = {"iban": 4, "key": 4}.get(kind, 0)
    stop = entity.rfind(".") if kind == "email" else len(entity)
    plain_hex = kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", entity)
    out, vowel = [], False
    for i, c in enumerate(entity):
        b = next(draw)
        if i < keep or i >= stop or not c.isalnum():
            out.append(c)
            vowel = False
        elif c.isdigit():
            out.append(str(b % 10))
        elif plain_hex:
            out.append(("ABCDEF" if c.isupper() else "abcdef")[b % 6])
        elif script := _script(c):
            pick = LETTERS[script][vowel]
            if kind in ("male", "female") and (i + 1 == len(entity) or not entity[i + 1].isalpha()):
                pick = LETTERS[script][1][:1] if kind == "female" else LETTERS[script][0]
            new = pick[b % len(pick)]
            out.append(new.upper() if c.isupper() else new)
            vowel = not vowel
        else:  # other scripts: a letter near by
            near = [chr(x) for x in range(ord(c) & ~15, (ord(c) | 15) + 1) if chr(x).isalpha() and chr(x) != c]
            out.append(near[b % len(near)] if near else c)
    new = "".join(out)
    if kind == "number" and _luhn(entity):
        new = next(new[:-1] + d for d in "0123456789" if _luhn(new[:-1] + d))
    if kind == "iban":
        new = f"{new[:2]}{98 - _iban_rest(new[:2] + '00' + new[4:]):02d}{new[4:]}"
    return new


def render(kind: str, mention: str, new: str) -> str:
    """``new`` in the separators and case of ``mention``."""
    if kind == "ip" or (kind in ("email", "secret", "key") and len(new) != len(mention)):
        return new
    if kind == "ipv6":
        groups = mention.split(":")
        if len(groups) == 8 and "" not in groups:  # written out
            new = ":".join(g[-max(len(w), len(g.lstrip("0"))) :] for g, w in zip(ipaddress.IPv6Address(new).exploded.split(":"), groups, strict=True))
        return new.upper() if any(c in "ABCDEF" for c in mention) else new
    chars, out = iter(c for c in new if c.isalnum()), []
    keep = sum(c.isdigit() for c in mention) - len(canonical(kind, mention)) if kind == "phone" else 0  # the calling code or trunk zero
    for c in mention:
        if keep and c.isdigit():
            keep -= 1
            out.append(c)
            continue
        new_c = next(chars, c) if c.isalnum() else c
        out.append(new_c.upper() if c.isupper() else new_c)
    rest = "".join(chars)
    return "".join(out) + (rest.upper() if mention.isupper() else rest)


_SPANS = "k1 long, k2 int, size long, a int, b int, kind string, entity string"


def _found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for k1, k2, size, text in zip(*[part.column(c).to_pylist() for c in ("k1", "k2", "size", "text")], strict=True):
            rows += [(k1, k2, size, *m) for m in mentions(text)]
        if rows:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["k1", "k2", "size", "a", "b", "kind", "entity"])


def _surrogates(key: bytes):
    def run(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, e, a) for k, e, a in zip(kind, entity, attempt, strict=True)])

    return F.pandas_udf(run, "string")


def entity_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity) -> (kind, entity, new): no two of a kind share ``new``, and ``new`` is no real entity of the kind. Given names of all genders count as one kind; initials are not compared.

    Whoever keeps its surrogate keeps it in later rounds too, as later draws rank behind it.
    """
    make = _surrogates(key)
    space = F.when(F.col("kind").isin(*GIVEN), "given").otherwise(F.col("kind")).alias("space")
    real = table(entities.distinct().select("*", space))
    at = table(real.withColumn("attempt", F.lit(0)).withColumn("new", make("kind", "entity", "attempt")))
    taken = real.select("space", F.col("entity").alias("new"), F.lit(True).alias("real")).distinct()
    while True:
        first = at.groupBy("space", "new").agg(F.min(F.struct("attempt", "kind", "entity")).alias("first"))
        judged = at.join(first, ["space", "new"]).join(taken, ["space", "new"], "left")
        bad = (F.col("kind") != "initial") & (F.col("real").isNotNull() | (F.col("entity") != F.col("first.entity")) | (F.col("kind") != F.col("first.kind")))
        judged = table(judged.select("kind", "entity", "space", "attempt", "new", bad.alias("bad")))
        if judged.filter("bad").isEmpty():
            return judged.select("kind", "entity", "new")
        again = judged.filter("bad").select("kind", "entity", "space", (F.col("attempt") + 1).alias("attempt")).withColumn("new", make("kind", "entity", "attempt"))
        at = table(again.unionByName(judged.filter("not bad").drop("bad")))


def joined_genders(found: DataFrame) -> DataFrame:
    """``found`` with one kind for each given name: the gender of its honorifics over all mentions, or ``given`` where there is none or they differ."""
    said = F.when(F.col("male") & ~F.col("female"), "male").when(F.col("female") & ~F.col("male"), "female").otherwise("given")
    own = found.filter(F.col("kind").isin(*GIVEN)).groupBy("entity").agg(F.bool_or(F.col("kind") == "male").alias("male"), F.bool_or(F.col("kind") == "female").alias("female"))
    own = own.select(F.col("entity").alias("name"), said.alias("gender"))
    given = F.when(F.col("kind").isin(*GIVEN), F.col("entity"))
    return found.join(own, given == F.col("name"), "left").withColumn("kind", F.coalesce("gender", "kind")).drop("name", "gender")


def _replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, own in zip(text, spans, strict=True):
        parts, at = [], 0
        for x in sorted(own, key=lambda x: x["a"]):
            parts += [t[at : x["a"]], render(x["kind"], t[x["a"] : x["b"]], x["new"])]
            at = x["b"]
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out)


def pseudonymise(docs: DataFrame, key: bytes = b"surrogates", text: str = "text") -> DataFrame:
    """``docs`` with entities replaced in ``text``, and ``n_entities``: the mentions replaced."""
    ship(docs.sparkSession)
    by = ["k1", "k2", "size"]
    t = text_of(text)
    keyed = packed(docs, text=t, k1=F.xxhash64(t), k2=F.hash(t), size=F.octet_length(t).cast("long"))
    found = table(joined_genders(table(keyed.select("text", *by).mapInArrow(_found, _SPANS).distinct())))
    new = entity_surrogates(found.select("kind", "entity"), key)
    spans = table(found.join(new, ["kind", "entity"]).groupBy(*by).agg(F.collect_list(F.struct("a", "b", "kind", "new")).alias("spans")))
    flagged = with_flag(keyed, key_bitmap(spans, by), by, "open")
    replaced = F.pandas_udf(_replaced, "string")

    def out(rows: DataFrame, new_text, n) -> DataFrame:
        cols = [new_text.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_entities"]
        return rows.select(*cols, n.cast("long").alias("n_entities"))

    none = lambda rows: out(rows, F.col("row").getField(text), F.lit(0))
    asked = flagged.filter("open").join(spans, by, "left")
    done = asked.filter("spans is not null").withColumn("text", replaced("text", "spans"))
    return none(flagged.filter("not open")).unionByName(none(asked.filter("spans is null"))).unionByName(out(done, F.col("text"), F.size("spans")))

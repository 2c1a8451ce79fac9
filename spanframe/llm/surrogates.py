"""Operator 10: personal data replaced by keyed surrogates of the same kind and format.

Found are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card and
other long numbers, social security numbers, IBANs, secrets, and persons named
with a title; later bare mentions of a person's names in the same text as well.
An entity's normal form and the key alone settle its surrogate, so mentions of
one entity stay mentions of one entity, in all documents. A first name has one gender in the whole corpus,
whatever title stands before it. Numbers go through keyed permutations of their
digits. All surrogates of the corpus are compared, as they are written, with
each other and with all real entities, all names together and all digit strings
together; where two meet, one draws again.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.batches import free_names, with_fields
from spanframe.session import materialize, ship_package

#: Titles by the gender they tell.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа"]
EITHER = ["Dr", "Prof"]

#: Name parts by script: stems, endings of male and female first names, endings of family names.
PARTS = {
    "LATIN": ("bal bren cal dar del fen gal har jor kel lan mar nor pel quin ral ser tor val wen".split(), "an or us ert".split(), "a ina elle ia".split(), "er son man well field ton".split()),
    "CYRILLIC": ("бал бор вел гор дар жел зар кал лад мир нор пол рад сав тор яр".split(), "ан ор ид ей".split(), "а ина ия ея".split(), "ов ин ский ич".split()),
    "GREEK": ("βαλ γορ δαρ καλ λαμ μαρ νορ παλ ρομ σερ ταλ φιλ".split(), "ος ης ιος ων".split(), "α η ια ινα".split(), "ακης ιδης οπουλος ου".split()),
}

_WORD = r"\p{Lu}[\p{L}'’-]+"
_PATTERNS = {
    "email": (regex.compile(r"(?<![\w.+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"), "@"),
    "secret": (regex.compile(r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,})(?!\w)"), None),
    "iban": (regex.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), None),
    "ipv6": (regex.compile(r"(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:.])"), ":"),
    "ipv4": (regex.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"), "."),
    "ssn": (regex.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-"),
    "card": (regex.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?![\w-])"), None),
    "phone": (regex.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,5}){1,4}|\(\d{2,5}\)[ .-]?\d{3,4}(?:[ .-]?\d{2,5}){1,2}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,9})(?![\w])"), None),
}
_TITLED = regex.compile(rf"(?<!\w)({'|'.join(MALE + FEMALE + EITHER)})\.? +({_WORD}(?: {_WORD})?)")
_DIGIT = re.compile(r"[0-9]")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of all mentions, in order and without overlap; kinds earlier in the list win."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))  # one mark a character, so a mention costs its own length, however many there are

    def add(a: int, b: int, kind: str, norm: str) -> None:
        if 1 not in taken[a:b]:
            taken[a:b] = b"\x01" * (b - a)
            found.append((a, b, kind, norm))

    digits = _DIGIT.search(text) is not None
    for kind, (pattern, sign) in _PATTERNS.items():
        if (kind == "email" or digits) and (sign is None or sign in text):
            for m in pattern.finditer(text):
                add(m.start(), m.end(), kind, normal(kind, m.group()))
    names: dict[str, str] = {}
    for m in _TITLED.finditer(text):
        gender = "m" if m[1] in MALE else "f" if m[1] in FEMALE else "x"
        words = m[2].split(" ")
        for place, word in enumerate(words):
            names.setdefault(word, "family" if place == len(words) - 1 else f"given-{gender}")
    if names:
        for m in regex.finditer(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(map(regex.escape, names), key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", text):
            add(m.start(), m.end(), names[m.group()], m.group().lower())
    return sorted(found)


def normal(kind: str, raw: str) -> str:
    """What is the same for all ways to write an entity."""
    if kind in ("card", "ssn", "phone"):
        return ("+" + raw[1:].split(" ")[0].split("(")[0].split("-")[0].split(".")[0] + ":" if raw[0] == "+" else "") + re.sub(r"\D", "", raw)
    if kind == "iban":
        return raw.replace(" ", "")
    return raw.lower() if kind in ("email", "ipv6") else raw


class Keyed:
    """Keyed choices: the same key, purpose and input give the same numbers everywhere."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, *what: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest(), "big")

    def permute(self, digits: str, *what: object) -> str:
        """Another digit string of the same length; different inputs have different outputs."""
        n = len(digits)
        if n < 2:
            return "".join(str((int(d) + self.number("one", *what)) % 10) for d in digits)
        half = n // 2
        a, b = int(digits[:half]), int(digits[half:])
        for r in range(4):
            a = (a + self.number(r, "a", b, n, *what)) % 10**half
            b = (b + self.number(r, "b", a, n, *what)) % 10**(n - half)
        return f"{a:0{half}d}{b:0{n - half}d}"

    def shape(self, text: str, *what: object) -> str:
        """Letters for letters, digits for digits (hexadecimal ones among themselves), the rest as it is."""
        stream, out = self.number("shape", text, *what), []
        hexadecimal = what[0] == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
        for i, c in enumerate(text):
            if i % 24 == 23:
                stream = self.number("more", i, text, *what)
            stream, k = divmod(stream, 997)
            if hexadecimal:
                out.append("0123456789abcdef"[k % 16] if text == text.lower() else "0123456789ABCDEF"[k % 16])
            elif c.isdigit():
                out.append(str(k % 10))
            elif c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + k % 26))
            else:
                out.append(c)
        return "".join(out)

    def surrogate(self, kind: str, norm: str, attempt: int) -> str:
        """Normal form of the surrogate of an entity; further attempts give others."""
        if kind == "email":
            local, _, domain = norm.partition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.shape(local, kind, attempt, domain)}{self.number('tail', norm, attempt) % 10**6 if attempt else ''}@{self.shape(host, 'host')}.{top}"
        if kind == "secret":
            head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|)", norm)[0]
            return head + self.shape(norm[len(head):], kind, attempt)
        if kind == "iban":
            body = self.shape(norm[4:], kind, attempt)
            value = "".join(str(int(c, 36)) for c in body + norm[:2])
            return f"{norm[:2]}{98 - int(value + '00') % 97:02d}{body}"
        if kind == "ipv4":
            value = 0
            for part in norm.split("."):
                value = value << 8 | int(part)
            a, b = value >> 16, value & 0xFFFF
            for r in range(4):
                a ^= self.number(r, "ip-a", b, attempt) & 0xFFFF
                b ^= self.number(r, "ip-b", a, attempt) & 0xFFFF
            return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
        if kind == "ipv6":
            value = self.number("ipv6", norm, attempt)
            return ":".join(f"{value >> 16 * i & 0xFFFF:x}" for i in range(8))
        if kind == "card":  # the first digit and whether the check digit fits stay
            body = norm[0] + self.permute(norm[1:-1], kind, attempt, norm[0], norm[-1])
            return body + str((_luhn(body) + int(norm[-1]) - _luhn(norm[:-1])) % 10)
        if kind in ("ssn", "phone"):
            head, _, digits = norm.rpartition(":")
            code = len(head) - 1 if head else 0
            keep = digits[:code] + ("0" if digits[code: code + 1] == "0" else "")
            return (head + ":" if head else "") + keep + self.permute(digits[len(keep):], kind, attempt, head, keep)
        return self._name(kind, norm, attempt)

    def _name(self, kind: str, norm: str, attempt: int) -> str:
        script = next((s for s in PARTS if regex.match(rf"\p{{{s.title()}}}", norm)), "LATIN")
        stems, male, female, family = PARTS[script]
        value = self.number(kind, norm, attempt)
        ends = family if kind == "family" else male if kind == "given-m" else female if kind == "given-f" else male + female
        out = ""
        for _ in range(2 + min(attempt, 4)):
            value, k = divmod(value, len(stems))
            out += stems[k]
        return out + ends[value % len(ends)]


def _luhn(body: str) -> int:
    """Check digit of a number without it."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def render(kind: str, raw: str, new: str) -> str:
    """A surrogate's normal form written as the mention was."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(new.rpartition(":")[2])
        return "".join(next(digits) if c.isdigit() else c for c in raw)
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in raw)
    if kind == "ipv6":
        return new.upper() if raw != raw.lower() else new
    if kind == "email":
        return new.upper() if raw.isupper() else new
    if kind == "family" or kind.startswith("given"):
        return new.upper() if len(raw) > 1 and raw.isupper() else new[:1].upper() + new[1:]
    return new


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (doc_id, kind, norm)."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for name, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if value:
                    rows += [(name, k, n) for k, n in {(k, n) for _, _, k, n in find(value)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]],
                                             names=["doc_id", "kind", "norm"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, kind string, norm string")


def written(kind: str, norm: str) -> tuple[Column, Column]:
    """(family of kinds, written form) of columns of kinds and normal forms: what readers can take for the same."""
    k, digits = F.col(kind), F.col(kind).isin("card", "ssn", "phone")
    family = F.when((k == "family") | k.startswith("given"), "name").when(digits, "digits").otherwise(k)
    return family, F.when(digits, F.regexp_replace(norm, "^.*:", "")).otherwise(F.col(norm))


def genders(held: DataFrame) -> DataFrame:
    """(kind, norm, settled): the first names whose kind in some documents is not the one of the corpus.

    The gender that more documents give is settled; without one, or with as many for both, it stays open.
    """
    given = held.where(F.col("kind").startswith("given")).groupBy("norm", "kind").agg(F.count("*").alias("n"))
    male, female = (F.coalesce(F.sum(F.when(F.col("kind") == f"given-{g}", F.col("n"))), F.lit(0)) for g in "mf")
    by = given.groupBy("norm").agg(male.alias("m"), female.alias("f"), F.collect_set("kind").alias("kinds"))
    settled = F.when(F.col("m") > F.col("f"), "given-m").when(F.col("f") > F.col("m"), "given-f").otherwise("given-x")
    return by.select(F.explode("kinds").alias("kind"), "norm", settled.alias("settled")).where("kind <> settled")


def assign(entities: DataFrame, secret: bytes, attempts: int = 64) -> DataFrame:
    """(kind, norm, attempt, surrogate) for distinct (kind, norm), without two written alike and none that is an entity itself.

    Where surrogates meet, the one drawn first stays (ties: the smaller entity);
    the others draw again, until none meet. Each round is one shuffle of the
    entities, and a written table.
    """
    ship_package(entities.sparkSession)
    schema = "kind string, norm string, attempt int, surrogate string"

    def draw(batches):
        keyed = Keyed(secret)
        for batch in batches:
            kinds, norms, tries = (batch.column(c).to_pylist() for c in ("kind", "norm", "attempt"))
            new = [keyed.surrogate(k, n, t) for k, n, t in zip(kinds, norms, tries)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "norm", "attempt")], pa.array(new, pa.string())],
                                             names=["kind", "norm", "attempt", "surrogate"])

    entities = materialize(entities.select("kind", "norm").distinct(), "entities")
    table = materialize(entities.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "surrogates")
    for _ in range(attempts):
        who = F.struct("attempt", "norm", "kind")
        family, form = written("kind", "norm")
        real = entities.select(family.alias("family"), form.alias("form"), F.lit(1).alias("real"), F.lit(None).cast("struct<attempt:int,norm:string,kind:string>").alias("who"))
        family, form = written("kind", "surrogate")
        drawn = table.withColumns({"family": family, "form": form, "who": who})
        met = drawn.select("family", "form", F.lit(0).alias("real"), "who").unionAll(real).groupBy("family", "form").agg(
            F.max("real").alias("real"), F.count("who").alias("n"), F.min("who").alias("keeps"))
        met = met.where("n > 0 and (real = 1 or n > 1)")
        bad = drawn.join(met, ["family", "form"]).where((F.col("real") == 1) | (F.col("who") != F.col("keeps"))).select("kind", "norm", "attempt")
        bad = materialize(bad, "met")
        if bad.isEmpty():
            return table
        again = bad.withColumn("attempt", F.col("attempt") + 1).mapInArrow(draw, schema)
        table = materialize(table.join(bad.select("kind", "norm"), ["kind", "norm"], "left_anti").unionAll(again), "surrogates")
    raise RuntimeError(f"surrogates still meet after {attempts} attempts")


def replace(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all mentions replaced, and ``n_entities`` (mentions replaced) added or replaced.

    Null texts stay null with 0 entities; texts without mentions stay as they
    are, byte for byte. Repeated rows are replaced alike. An empty table gives
    an empty table. A mention's surrogate follows from the key, so the texts
    are not joined with the table of surrogates; only entities that had to draw
    again, and first names of another gender than their title tells, are handed
    to the documents that hold them, by a join on the id that Spark sizes itself.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = materialize(mentions(docs, key, text), "mentions")
    turned = materialize(genders(held), "genders")
    named = held.join(turned, ["kind", "norm"], "left").withColumn("settled", F.coalesce("settled", "kind"))
    table = assign(named.select(F.col("settled").alias("kind"), "norm"), secret)
    again = table.where("attempt > 0").select(F.col("kind").alias("settled"), "norm", "attempt")
    changed = named.join(again, ["settled", "norm"], "left").where("attempt is not null or settled <> kind")
    kept = docs.drop("n_entities")
    of, redrawn_name = free_names(kept.columns, "_id", "_redrawn")
    redrawn = materialize(changed.groupBy(F.col("doc_id").alias(of)).agg(
        F.collect_set(F.struct("kind", "norm", "settled", F.coalesce("attempt", F.lit(0)).alias("attempt"))).alias(redrawn_name)), "redrawn")
    joined = kept.join(redrawn, kept[key].cast("long").eqNullSafe(F.col(of)), "left").drop(of)

    def run(batches):
        keyed = Keyed(secret)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            values, other = batch.column(at).to_pylist(), batch.column(redrawn_name).to_pylist()
            count = [0] * len(values)
            for i, value in enumerate(values):
                if value and (found := find(value)):
                    tries = {(x["kind"], x["norm"]): (x["settled"], x["attempt"]) for x in other[i] or []}
                    parts, head = [], 0
                    for a, b, kind, norm in found:
                        settled, attempt = tries.get((kind, norm), (kind, 0))
                        parts += [value[head:a], render(kind, value[a:b], keyed.surrogate(settled, norm, attempt))]
                        head = b
                    values[i], count[i] = "".join([*parts, value[head:]]), len(found)
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != redrawn_name]
            columns[at] = pa.array(values, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64())], names=[*[n for n in batch.schema.names if n != redrawn_name], "n_entities"])

    return joined.mapInArrow(run, with_fields(kept.schema, n_entities="long"))

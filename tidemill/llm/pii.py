"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is DataFrame functions on one row; no shuffle. Positions come from the lengths of the matches and of the
pieces between them. The expressions are written so that each finds what the plain form of its docstring would find,
but without reading a long run of characters again from each of its places and without recursion on long texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, table

SPANS = "array<struct<start:int,end:int,score:double>>"
ACCEPT, CONTEXT_CHARS = 0.5, 40
#: Between the members of a list: a separator, a conjunction, or no word at all.
LIST_GAP = r"[,;/|&\n\t]|(?i:\b(?:and|or|und|oder|et|ou|y|o|e)\b)|^[^\p{L}\p{N}]*$"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}[A-Za-z0-9]?"
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28
    CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26
    IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24
    PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20
    YE30""".split()}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass the Luhn check."""
    values = F.transform(F.reverse(F.split(_digits(number), "")), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number (country, two check digits, rest) leaves 1 when divided by 97."""
    plain = F.upper(F.regexp_replace(account, "[^A-Za-z0-9]", ""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).when(
        c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)) == 1


def _account(run: Column) -> Column:
    """The account number that ``run``, a match of ``IBAN``, begins with; null for none.

    The expression runs on into words and numbers that follow, so the end of each group of ``run`` may be the end: that
    which gives the length of the country's numbers, or else the last that passes mod 97.
    """
    groups = F.split(run, " ")

    def size(x: Column) -> Column:
        return F.length(F.replace(x, F.lit(" "), F.lit("")))

    heads = F.transform(groups, lambda _, i: F.array_join(F.slice(groups, F.lit(1), i + 1), " "))
    good = F.filter(heads, lambda x: size(x).between(15, 34) & ~x.rlike("[a-z]") & mod_97(x))
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    usual = F.filter(good, lambda x: size(x) == F.try_element_at(lengths, F.substring(run, 1, 2)))
    return F.coalesce(F.get(usual, F.lit(0)), F.try_element_at(good, F.lit(-1)))


def _octets(x: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return x.rlike(rf"^{part}(?:\.{part}){{3}}$")


@dataclass(frozen=True)
class Kind:
    """What proposes, what confirms, and the score without and with a context word close by."""

    name: str
    pattern: str
    confirm: object
    score: float
    context: str
    bonus: float
    base: bool = True


#: Base kinds in the order of the contract, then those that the method adds.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda x: F.lit(True), 0.9, "mail|contact|kontakt|correo|courriel", 0.1),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.6, r"\bip\b|address|adresse|host|server", 0.3),
    # [0-9]([\x20-]?[0-9])+ with 13 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", luhn, 0.7,
         "card|visa|karte|carte|tarjeta", 0.3),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: F.length(_digits(x)).between(9, 15), 0.6,
         r"phone|\btel|call|mobil|fax|llam", 0.3),
    # An empty match before each place where a number may begin, so that one does not hide the next.
    Kind("iban", rf"(?<![A-Za-z0-9])(?=({IBAN}(?s:.{{0,{CONTEXT_CHARS}}})))", _account, 0.8,
         "iban|account|konto|compte|cuenta", 0.2, base=False),
    Kind("ssn", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
         lambda x: F.lit(True), 0.3, r"ssn|social security|security n|national id", 0.5, base=False),
)


def spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of ``kind`` in order, as (start, end, score): code points, end exclusive.

    A confirmed span of a base kind always stays; the others need a score of ``ACCEPT``, which takes context words
    within ``CONTEXT_CHARS`` before or after, up to the next match. A context word beside one member of a list (matches
    with a ``LIST_GAP`` of at most ``CONTEXT_CHARS`` between them) holds for all its members.
    """
    if kind.name == "iban":
        return _accounts(text, kind)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    none = F.array().cast(SPANS)

    def near(gap: Column, after: Column) -> Column:
        return F.lower(F.concat(F.right(gap, F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(after, F.lit(CONTEXT_CHARS)))) \
            .rlike(kind.context)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        close = near(x["gap"], x["after"])
        if kind.base:
            score = F.lit(kind.score) + F.when(close, kind.bonus).otherwise(0.0)
            one = F.array(F.struct(start.alias("start"), end.alias("end"), score.alias("score"))).cast(SPANS)
            good = kind.confirm(x["match"])
            return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))
        listed = (state["at"] > 0) & (F.length(x["gap"]) <= CONTEXT_CHARS) & x["gap"].rlike(LIST_GAP)
        held = close | listed & state["held"]
        one = F.when(kind.confirm(x["match"]), F.array(F.struct(
            start.alias("start"), end.alias("end"), F.lit(kind.score + kind.bonus).alias("score"))).cast(SPANS)) \
            .otherwise(none)
        waiting = F.concat(F.when(listed, state["waiting"]).otherwise(none), one)
        return F.struct(end.alias("at"), F.when(held, F.concat(state["out"], waiting)).otherwise(state["out"]).alias("out"),
                        F.when(held, none).otherwise(waiting).alias("waiting"), held.alias("held"))

    # The last gap has no match; arrays_zip gives it a null one.
    zipped = F.slice(F.arrays_zip(gaps.alias("gap"), matches.alias("match"),
                                  F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1))).alias("after")),
                     F.lit(1), F.size(matches))
    # ``waiting``: members of the current list without a context word so far; ``held``: whether it has one.
    start = F.struct(F.lit(0).alias("at"), none.alias("out"), *(
        () if kind.base else (none.alias("waiting"), F.lit(False).alias("held"))))
    found = F.aggregate(zipped, start, step, lambda s: s["out"])
    return F.when(text.rlike(kind.pattern), found).otherwise(none)


def _accounts(text: Column, kind: Kind) -> Column:
    """``spans`` for account numbers: those that do not overlap, from the left, with all of the text as context."""
    # Behind a blank, as an empty match at the beginning would not part the text.
    text, none = F.concat(F.lit(" "), text), F.array().cast(SPANS)
    pieces = F.split(text, kind.pattern, -1)
    zipped = F.slice(F.arrays_zip(pieces.alias("piece"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)).alias("ahead")),
                     F.lit(1), F.size(pieces) - 1)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        before = F.right(F.concat(state["before"], F.right(x["piece"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        size = F.length(kind.confirm(F.regexp_extract(x["ahead"], f"^{IBAN}", 0)))
        near = F.lower(F.concat(before, F.lit(" "), F.substring(x["ahead"], size + 1, F.lit(CONTEXT_CHARS)))).rlike(kind.context)
        one = F.array(F.struct(start.alias("start"), (start + size).alias("end"), (
            F.lit(kind.score) + F.when(near, kind.bonus).otherwise(0.0)).alias("score"))).cast(SPANS)
        good = size.isNotNull() & (start >= state["end"])
        return F.struct(start.alias("at"), F.when(good, start + size).otherwise(state["end"]).alias("end"), before.alias("before"),
                        F.when(good, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("end"), F.lit("").alias("before"), none.alias("out"))
    return F.when(text.rlike(kind.pattern), F.aggregate(zipped, start, step, lambda s: s["out"])).otherwise(none)


def find(docs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with a column of spans for each kind, under its name (or the name given for it).

    Null text counts as empty; an empty table gives an empty result; repeated rows are treated alike. Columns of
    ``docs`` that have the name of a result give way to it.
    """
    names = names or {k.name: k.name for k in KINDS}
    docs = docs.drop(*names.values())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(spans(text, k).alias(names[k.name]) for k in KINDS))


def _listed(columns: list[tuple[str, Column]]) -> Column:
    def one(kind: str):
        return lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])

    return F.array_join(F.concat(*(F.transform(c, one(k)) for k, c in columns)), ",")


def redacted(text: Column, found: list[tuple[str, Column]]) -> Column:
    """``text`` with each stretch of overlapping spans replaced by the bracketed name of its first kind."""
    one = "array<struct<start:int,end:int,kind:string>>"

    def named(kind: str):
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))

    every = F.array_sort(F.concat(*(F.transform(c, named(k)) for k, c in found)))

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
                         last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (x["start"] < last["end"]),
                      F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))) \
            .otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(every, F.array().cast(one), merge)

    def cut(state: Column, x: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        return F.struct(x["end"].alias("at"), F.concat(
            state["out"], F.array(F.concat(kept, F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(merged, start, cut, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by a mark such as [EMAIL]; ``n_chars``, if there, follows."""
    names = {k.name: fresh(k.name, docs.columns) for k in KINDS}
    found = [(k.name, F.col(f"`{names[k.name]}`")) for k in KINDS]
    some = reduce(lambda a, b: a | b, (F.size(c) > 0 for _, c in found))
    out = find(docs, names).withColumn("text", F.when(some, redacted(F.col("text"), found)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many spans of each base kind its text has (``n_email``, ``n_ip``, ``n_card``, ``n_phone``),
    ``spans`` (kind:start:end of all kinds) and ``base_sha256``, the digest of the base ones. Null counts as empty."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    columns = [(k.name, F.col(k.name)) for k in KINDS]
    base = columns[:sum(k.base for k in KINDS)]
    return found.select("doc_id", *(F.size(c).cast("long").alias(f"n_{k}") for k, c in base),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(columns).alias("spans"))

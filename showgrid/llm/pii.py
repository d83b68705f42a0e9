"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid.llm.common import documents
from showgrid.llm.queries import query
from showgrid.llm.spans import SPAN, chunks, count_kind, find_spans, larger, let, part, running, span_list, spans_if

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "idnum"]

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A local part is entered at its start or where the match before ended. The domain is a lazy run of one character class that
#: ends where neither a label character nor a dot with one follows: labels without a repeated group, so no deep stack.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++\.{LABEL}[A-Za-z0-9.-]*?(?!{LABEL}|\.{LABEL})"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single separators that has 12 to 19 digits; other runs fail as wholes and need no match.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Where a code may start, and the longest run from there: 15 to 34 characters with single spaces.
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
IBAN_LEAST, IBAN_REACH = 15, 65
IDNUM = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

#: Prior of a confirmed span, and words near it that raise or lower its score by ``STEP``.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "idnum": 0.4}
RAISES = {"email": "mail|contact|write|reach", "ip": "address|host|login|server|client", "card": "card|visa|payment|credit|expir",
          "phone": "phone|call|tel|mobile|fax|whatsapp", "iban": "iban|bank|account|transfer", "idnum": "ssn|social|security|tax|identity"}
LOWERS = {"email": "example|noreply", "ip": "version|release|section", "card": "isbn|order|serial|sku", "phone": "fax|version|part",
          "iban": "part|model", "idnum": "part|order|isbn|version"}
STEP, REACH, ADD_FROM = 0.2, 40, 0.5


def luhn(digits: Column) -> Column:
    """Sum from the right, every second digit doubled and reduced by 9 above 9; valid if divisible by 10."""
    back = F.split(F.reverse(digits), "")
    def weigh(d, i):
        d = d.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    parts = F.transform(F.filter(back, lambda d: d != ""), weigh)
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """First four characters to the end, letters as 10 to 35, remainder 1 by 97."""
    plain = F.regexp_replace(code, r"\x20", "")
    turned = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def iban_spans(text: Column) -> Column:
    """Codes that pass mod-97. Words or numbers may follow a code in capitals: of the run from its start, the longest valid
    part that ends before a space or with the run counts. A start inside an earlier code is not a code of its own."""
    def longest(pieces, head):
        run = F.split(F.regexp_extract(part(pieces, head["start"], head["start"] + IBAN_REACH), IBAN, 0), " ")
        parts = F.transform(F.sequence(F.size(run), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(run, F.lit(1), n), " "))
        code = F.get(F.filter(parts, lambda p: (F.length(F.regexp_replace(p, r"\x20", "")) >= IBAN_LEAST) & mod97(p)), F.lit(0))
        return F.struct(F.lit("iban").alias("kind"), head["start"].alias("start"), (head["start"] + F.length(code)).cast("int").alias("end"), code.alias("text"))

    def codes(heads):
        return let(chunks(text), lambda pieces: F.filter(F.transform(heads, lambda h: longest(pieces, h)), lambda s: s["text"].isNotNull()))

    def apart(found):  # codes that stand one in another are rare: only where there are some, they are gone through one by one
        last = F.concat(F.array(F.lit(0)), running(F.transform(found, lambda s: s["end"]), 0, larger))
        clash = F.exists(F.zip_with(found, F.slice(last, F.lit(1), F.size(found)), lambda s, e: s["start"] < e), lambda x: x)
        step = lambda out, s: F.when(F.coalesce(F.element_at(out, -1)["end"] > s["start"], F.lit(False)), out).otherwise(F.concat(out, F.array(s)))
        none = F.array().cast(f"array<{SPAN}>")
        return F.when(clash, F.aggregate(found, none, lambda out, s: F.when(F.size(out) == 0, F.array(s)).otherwise(step(out, s)))).otherwise(found)

    return let(find_spans(text, IBAN_HEAD, "iban"), lambda heads: F.when(F.size(heads) > 0, let(codes(heads), apart)).otherwise(F.array().cast(f"array<{SPAN}>")))


def n_digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def context_score(pieces: Column, kind: str, start: Column, end: Column) -> Column:
    """Prior of the kind, plus or minus ``STEP`` for words that stand within ``REACH`` characters; within 0 and 1."""
    near = F.lower(F.concat(part(pieces, F.greatest(start - REACH, F.lit(0)), start), F.lit(" "), part(pieces, end, end + REACH)))
    score = (F.lit(PRIOR[kind]) + F.when(near.rlike(RAISES[kind]), STEP).otherwise(0.0) - F.when(near.rlike(LOWERS[kind]), STEP).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def pii_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``whole`` (the text, null as empty) and ``spans``: array of struct<kind, start, end, text, score>.

    Base kinds stay whatever their score; ``iban`` needs mod-97 and ``idnum`` a score of ``ADD_FROM`` from its context. Empty
    and null texts have no spans, very long ones and many matches take time in proportion. A document is one row throughout, so repeated rows and hot sources need no care. Other
    columns are left out.
    """
    t = F.col("whole")
    octets = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
    digit = t.rlike("[0-9]")
    raw = {
        "email": spans_if(t.contains("@"), find_spans(t, EMAIL, "email")),
        "ip": spans_if(digit, F.filter(find_spans(t, IP, "ip"), lambda s: s["text"].rlike(octets))),
        "card": spans_if(digit, F.filter(find_spans(t, CARD, "card"), lambda s: luhn(F.regexp_replace(s["text"], "[^0-9]", "")))),
        "phone": spans_if(t.contains("+"), F.filter(find_spans(t, PHONE, "phone"), lambda s: n_digits(s["text"]).between(9, 15))),
        "iban": spans_if(digit, iban_spans(t)),
        "idnum": spans_if(digit, find_spans(t, IDNUM, "idnum")),
    }
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("whole")).select(*keep, "whole", *[v.alias(f"raw_{k}") for k, v in raw.items()])

    def scored(kind):
        raw = F.col(f"raw_{kind}")
        of = lambda pieces: F.transform(raw, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), context_score(pieces, kind, s["start"], s["end"]).alias("score")))
        return F.when(F.size(raw) > 0, let(chunks(t), of)).otherwise(F.array().cast(f"array<{SPAN[:-1]},score:double>>"))

    parts = [scored(k) for k in raw if k != "idnum"] + [F.filter(scored("idnum"), lambda s: s["score"] >= ADD_FROM)]
    return out.select(*keep, "whole", F.concat(*parts).alias("spans"))


@query("op6_pii")
def op6(spark, folder):
    found = pii_spans(documents(spark, folder).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select(
        "doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE], F.sha2(span_list(base, BASE), 256).alias("base_sha256"),
        span_list(F.col("spans"), BASE + ADDED).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))

"""Spans of regular expressions with code point offsets, in SQL functions only.

A span is struct<kind, start, end, text>, ``end`` exclusive. The matches of a pattern come from ``regexp_extract_all``; the
text between them from ``split`` by the same pattern; running sums of both lengths give the offsets. Patterns are written
so that a scan is linear in the text: a run of characters is entered at its start only and never given back. Long texts and many matches stay linear as well:
sums go block by block, and parts of a text are cut from its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,text:string>"


#: Values of an array that are summed up in one go, and characters of a chunk of text.
BLOCK, CHUNK = 256, 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def running(values: Column, zero: int, op) -> Column:
    """Inclusive running result of an associative ``op`` over an int array. Blocks first, then inside each block, so that arrays are only ever appended to within a block."""
    def inside(block, begin):
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out")), lambda acc: acc["out"])

    def blocks_of(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(blocks):
        totals = inside(F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), op)), F.lit(zero))
        return F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(zero)), totals), lambda b, s: F.when(b.isNotNull(), inside(b, s)).otherwise(F.array().cast("array<int>"))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks_of(v), joined)).otherwise(F.array().cast("array<int>")))


def find_spans(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` in a text that is not null, in order. Linear in the text and, but for one append a block, in the matches."""
    def placed(found):
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("int"))
        return F.zip_with(found, running(steps, 0, lambda a, x: a + x), lambda m, end: F.struct(
            F.lit(kind).alias("kind"), (end - F.length(m)).cast("int").alias("start"), end.alias("end"), m.alias("text")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points. A part of the text is then cut from the pieces it lies in, not counted off from the start of the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` of the text of ``pieces``; positions outside of it are left out."""
    first = F.floor(begin / CHUNK).cast("int")
    n = F.floor((end - 1) / CHUNK).cast("int") - first + 1
    return F.when(end > begin, F.substring(F.array_join(F.slice(pieces, first + 1, n), ""), begin - first * CHUNK + 1, end - begin)).otherwise(F.lit(""))


def apart_from(spans: Column, others: Column) -> Column:
    """Spans that overlap none of ``others``: by one sort and the running last end before and first start behind."""
    far = 2**31 - 1
    event = lambda k: lambda s: F.struct(s["start"].alias("a"), F.lit(k).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"), s["text"].alias("text"))

    def kept(events):
        last = running(F.transform(events, lambda e: F.when(e["k"] == 0, e["b"]).otherwise(0)), 0, larger)
        following = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["k"] == 0, e["a"]).otherwise(far))), far, smaller))
        seen = F.zip_with(events, F.zip_with(last, following, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda e, n: F.struct(e.alias("e"), n.alias("n")))
        free = F.filter(seen, lambda z: (z["e"]["k"] == 1) & (z["n"]["x"] <= z["e"]["a"]) & (z["n"]["y"] >= z["e"]["b"]))
        return F.transform(free, lambda z: F.struct(z["e"]["kind"].alias("kind"), z["e"]["a"].alias("start"), z["e"]["b"].alias("end"), z["e"]["text"].alias("text")))

    return let(F.array_sort(F.concat(F.transform(others, event(0)), F.transform(spans, event(1)))), kept)


def spans_if(condition: Column, spans: Column) -> Column:
    """``spans`` where a cheap test says that there may be one, else none."""
    return F.when(condition, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def span_list(spans: Column, order: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind in ``order``, joined by commas."""
    rank = F.array(*[F.lit(k) for k in order])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("d")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replace_spans(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span, overlapping ones merged, replaced by ``[mark]``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))

    def replaced(pieces, places, ends):
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        new = F.zip_with(places, before, lambda s, p: F.when(s["a"] < p, F.lit("")).otherwise(F.concat(part(pieces, p, s["a"]), F.lit(f"[{mark}]"))))
        return F.array_join(F.concat(new, F.array(part(pieces, F.element_at(ends, -1), F.size(pieces) * CHUNK))), "")

    done = let(chunks(text), lambda pieces: let(ordered, lambda places: let(
        running(F.transform(places, lambda s: s["b"]), 0, larger), lambda ends: replaced(pieces, places, ends))))
    return F.when(F.size(spans) > 0, done).otherwise(text)

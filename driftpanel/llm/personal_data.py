r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Column expressions only. A span's place is the sum of the lengths of what stands before
it, taken from the text split at the matches. The patterns are written so that no text,
however long, is scanned more than a few times: possessive loops, and a start only at the
first character of a run or where the last match ended, as the rest of a run can't match
when its beginning doesn't. Words nearby are those of the NEAR characters before and after
a span, whatever else was found in them.

Null and empty texts have no spans. Rows don't meet, so repeated rows give repeated
results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.binding import bind
from driftpanel.llm.common import only, prepared, sha256_of

BLOCK = 256  # matches summed together, for linear work on texts with very many
NEAR = 48  # characters before and after a span that are looked at for context words


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def summed(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, v: a + v)


def luhn(m: Column) -> Column:
    """12 to 19 digits whose Luhn sum ends in 0."""
    def valid(d: Column) -> Column:
        from_right = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.struct(
            i.alias("i"), F.substring(d, -i, F.lit(1)).cast("int").alias("v")))
        doubled = F.transform(from_right, lambda x: F.when(x["i"] % 2 == 1, x["v"]).otherwise(
            2 * x["v"] - F.when(x["v"] > 4, 9).otherwise(0)))
        return F.length(d).between(12, 19) & (summed(doubled, "int") % 10 == 0)

    return bind(digits(m), valid)


def octets(m: Column) -> Column:
    """Every part is at most 255."""
    parts = F.transform(F.split(m, "[.]"), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def phone_digits(m: Column) -> Column:
    return F.length(digits(m)).between(9, 15)


def mod97(m: Column) -> Column:
    """15 to 34 letters and digits; the number they spell, first four last, leaves 1."""
    def valid(c: Column) -> Column:
        turned = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
        codes = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
        left = F.aggregate(codes, F.lit(0), lambda a, v: F.when(v < 58, (a * 10 + v - 48) % 97).otherwise((a * 100 + v - 55) % 97))
        return F.length(c).between(15, 34) & (left == 1)

    return bind(F.regexp_replace(m, " ", ""), valid)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # every text with a match has a match of this, too; cheap to look for
    test: Callable[[Column], Column]
    score: float
    context: str  # words nearby that raise the score
    least: float = 0.0  # spans below are dropped


# The order of the kinds is the order of spans that begin together; the first BASE_KINDS
# don't depend on their score.
BASE_KINDS = 4
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.7, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", octets, 0.5, "ip|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", luhn, 0.6, "card|visa|credit|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", phone_digits, 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
         "[A-Z]{2}[0-9]{2}", mod97, 0.7, "iban|bank|account|transfer", 0.5),
    # Nothing confirms these numbers but the words nearby.
    Kind("national_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[0-9]-[0-9]",
         lambda m: ~F.substring(m, 1, 3).isin("000", "666"), 0.3, "ssn|social security|national id|tax id", 0.5),
)

SPAN = "array<struct<start:long,place:int,kind:string,end:long,score:double>>"


def spans_of(text: Column, place: int, kind: Kind) -> Column:
    """Spans of one kind, in order."""

    def span(match: Column, window: Column, start: Column) -> Column:
        near = F.lower(window).rlike(rf"\b(?:{kind.context})")
        return F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(kind.name).alias("kind"),
                        (start + F.length(match)).alias("end"), (F.lit(kind.score) + F.when(near, 0.3).otherwise(0.0)).alias("score"),
                        match.alias("match"))

    def placed(x: Column) -> Column:
        gaps, matches = x["gaps"], x["matches"]
        steps = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
        block = lambda i: F.floor(i / BLOCK).cast("int")
        end, begin = lambda s: F.substring(s, -NEAR, NEAR), lambda s: F.substring(s, 1, NEAR)
        # The text next to each gap, for gaps shorter than NEAR: matches aren't empty, so
        # NEAR of them with their gaps are enough, and NEAR characters of each.
        lefts = F.transform(matches, lambda m, j: end(F.concat(end(F.get(gaps, j)), m)))
        rights = F.transform(matches, lambda m, j: begin(F.concat(m, begin(F.get(gaps, j + 1)))))

        def window(i: Column, left: Column, right: Column) -> Column:
            before, after = F.get(gaps, i), F.get(gaps, i + 1)
            more = F.array_join(F.slice(left, F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR))), "")
            rest = F.array_join(F.slice(right, i + 2, F.lit(NEAR)), "")
            return F.concat(F.when(F.length(before) >= NEAR, end(before)).otherwise(end(F.concat(more, before))), F.lit("\n"),
                            F.when(F.length(after) >= NEAR, begin(after)).otherwise(begin(F.concat(after, rest))))

        def with_steps(s: Column) -> Column:
            blocks = F.sequence(F.lit(0), block(F.size(s)))
            before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, k: F.concat(
                a, F.array(F.get(a, k) + summed(F.slice(s, k * BLOCK + 1, F.lit(BLOCK))))))
            beside = F.struct(before.alias("p"), lefts.alias("left"), rights.alias("right"))
            return bind(beside, lambda b: F.transform(matches, lambda m, i: span(m, window(i, b["left"], b["right"]), (
                F.get(b["p"], block(i)) + summed(F.slice(s, block(i) * BLOCK + 1, i % BLOCK)) + F.length(F.get(gaps, i))))))

        return bind(steps, with_steps)

    found = bind(F.struct(F.split(text, kind.pattern, -1).alias("gaps"),
                          F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches")), placed)
    tested = F.filter(found, lambda s: kind.test(s["match"]) & (s["score"] >= kind.least))
    plain = F.transform(tested, lambda s: F.struct(s["start"], s["place"], s["kind"], s["end"], s["score"]))
    may = F.contains(text, F.lit("@")) if kind.needs == "@" else F.rlike(text, F.lit(kind.needs))
    return F.when(may, plain.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its spans, by place: code points, end exclusive."""
    prepared(docs.sparkSession)
    named = only(docs, doc_id=doc_id, text=text)
    whole = F.coalesce("text", F.lit(""))
    spans = F.array_sort(F.concat(*[spans_of(whole, i, kind) for i, kind in enumerate(KINDS)]))
    return named.select("doc_id", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["place"] < BASE_KINDS)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k.name) for k in KINDS[:BASE_KINDS]], sha256_of(written(base)).alias("base_sha256"),
                        F.concat_ws(",", written(F.col("spans"))).alias("spans"))

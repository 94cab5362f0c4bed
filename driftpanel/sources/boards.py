"""Board payloads: landing zone, strict decoding, one common posting shape.

A landing row is one fetched payload: ``provider``, ``company``, ``payload``.
Decoding is one narrow pass: parse, open each object once whatever the case of its names,
check types and read there, explode. No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from driftpanel.functions import variants as V
from driftpanel.functions.binding import bind, bind_all
from driftpanel.functions.keys import with_identity
from driftpanel.functions.moments import millis_to_epoch, rfc3339_epoch

# Providers that can be decoded. Fixed values.
PROVIDERS = ("greenhouse", "ashby", "lever")

_POSTING_FIELDS = (
    "title", "company", "location", "description", "url", "source", "posted_at", "is_remote",
)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per fetch under ``provider=<p>/company=<c>/``."""
    files = spark.read.option("basePath", path).text(path, wholetext=True)
    return files.select(
        F.col("provider").cast("string"), F.col("company").cast("string"), F.col("value").alias("payload")
    )


def mentions_remote(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("remote"))


def _posting(title: Column, location: Column, description: Column, url: Column, source: Column,
             posted_at: Column, is_remote: Column) -> Column:
    return F.struct(
        title.alias("title"), F.col("company"), location.alias("location"),
        description.alias("description"), url.alias("url"), source.alias("source"),
        posted_at.cast("bigint").alias("posted_at"), is_remote.alias("is_remote"),
    )


def _typed(found: Column, *names: str, kinds: tuple[str, ...] = (V.TEXT,)) -> list[Column]:
    return [V.has_type(found[name], *kinds) for name in names]


def _object(value: Column, names: tuple[str, ...], read: Callable[[Column], Column], broken: Column) -> Column:
    """What ``read`` makes of an object's fields, absent ones for null; ``broken`` for anything else."""
    return bind(V.opened(value), lambda m: F.when(m.isNotNull() | V.nothing(value), bind(V.lowered(m, *names), read)).otherwise(broken))


def _text(value: Column) -> Column:
    return V.text_at(value, "$")


def _decoded(ok: list[Column], listed: Column, posting: Column) -> Column:
    return F.struct(V.all_of(ok).alias("ok"), listed.alias("listed"), posting.alias("posting"))


# Wire names, in lower case. Fixed values.
_GREENHOUSE = ("title", "content", "absolute_url", "updated_at", "location", "pay_input_ranges")
_PAY_TEXTS, _PAY_NUMBERS = ("title", "currency_type", "interval"), ("min_cents", "max_cents")
_ASHBY_TEXTS = ("title", "location", "department", "team", "descriptionhtml", "publishedat", "employmenttype", "joburl")
_ASHBY_FLAGS = ("islisted", "isremote")
_LEVER_TEXTS = ("id", "text", "hostedurl", "applyurl", "workplacetype", "descriptionplain")
_LEVER_CATEGORIES = ("commitment", "department", "location", "team")


def _pay_range_ok(item: Column) -> Column:
    return _object(item, _PAY_TEXTS + _PAY_NUMBERS, lambda r: V.all_of(
        _typed(r, *_PAY_TEXTS) + _typed(r, *_PAY_NUMBERS, kinds=V.NUMBERS)), F.lit(False))


def _one_text(value: Column, name: str, others: tuple[str, ...] = ()) -> Column:
    """A text inside an inner object; null unless the object is well typed."""
    names = (name, *others)
    return _object(value, names, lambda f: F.when(V.all_of(_typed(f, *names)), _text(f[name])), F.lit(None).cast("string"))


def _greenhouse(item: Column) -> Column:
    def read(f: Column) -> Column:
        def with_parts(x: Column) -> Column:
            ranges, location, content = x["ranges"], x["location"], x["content"]
            ok = _typed(f, "title", "content", "absolute_url", "updated_at") + [
                location.isNotNull(), ranges.isNotNull() | V.nothing(f["pay_input_ranges"]),
                F.forall(F.coalesce(ranges, _no_items()), _pay_range_ok)]
            return _decoded(ok, F.lit(True), _posting(
                _text(f["title"]), location, content, _text(f["absolute_url"]), F.concat(F.lit("greenhouse:"), F.col("company")),
                rfc3339_epoch(_text(f["updated_at"])), mentions_remote(location) | mentions_remote(content)))

        return bind_all(with_parts, ranges=V.list_at(f["pay_input_ranges"], "$"), location=_one_text(f["location"], "name"),
                        content=_text(f["content"]))

    return _object(item, _GREENHOUSE, read, F.lit(None))


def _ashby(item: Column) -> Column:
    """A posting without the flag counts as unlisted."""
    def read(f: Column) -> Column:
        return _decoded(_typed(f, *_ASHBY_TEXTS) + _typed(f, *_ASHBY_FLAGS, kinds=(V.FLAG,)), V.flag_at(f["islisted"], "$"), _posting(
            _text(f["title"]), _text(f["location"]), _text(f["descriptionhtml"]), _text(f["joburl"]), F.lit("ashby"),
            rfc3339_epoch(_text(f["publishedat"])), V.flag_at(f["isremote"], "$")))

    return _object(item, _ASHBY_TEXTS + _ASHBY_FLAGS, read, F.lit(None))


def _lever(item: Column) -> Column:
    def read(f: Column) -> Column:
        def with_location(location: Column) -> Column:
            ok = _typed(f, *_LEVER_TEXTS) + _typed(f, "createdat", kinds=(V.WHOLE,)) + [location.isNotNull()]
            return _decoded(ok, F.lit(True), _posting(
                _text(f["text"]), location, _text(f["descriptionplain"]), _text(f["hostedurl"]), F.concat(F.lit("lever:"), F.col("company")),
                millis_to_epoch(V.whole_at(f["createdat"], "$")), _text(f["workplacetype"]) == "remote"))

        return bind(_one_text(f["categories"], "location", tuple(c for c in _LEVER_CATEGORIES if c != "location")), with_location)

    return _object(item, (*_LEVER_TEXTS, "createdat", "categories"), read, F.lit(None))


def _no_items() -> Column:
    return F.array().cast("array<variant>")


def _by_provider(per_provider: dict[str, Column]) -> Column:
    return reduce(
        lambda chain, pair: chain.when(F.col("provider") == pair[0], pair[1]),
        list(per_provider.items())[1:],
        F.when(F.col("provider") == next(iter(per_provider)), next(iter(per_provider.values()))),
    )


def _opened(payload: Column) -> Column:
    """The payload's items and whether its outer shape is right.

    A bare ``null`` is an empty payload, and so is one whose list is absent or null.
    """
    def of_list(items: Column) -> Column:
        return F.struct(items.alias("items"), (items.isNotNull() | is_null).alias("shaped"))

    def of_object(body: Column) -> Column:
        def with_jobs(jobs: Column) -> Column:
            return bind(V.list_at(jobs, "$"), lambda items: F.struct(
                items.alias("items"), (body.isNotNull() & (items.isNotNull() | V.nothing(jobs)) | is_null).alias("shaped")))

        return bind(V.lowered(body, "jobs")["jobs"], with_jobs)

    is_null = F.trim(payload) == "null"
    return F.when(F.col("provider") == "lever", bind(F.from_json(payload, "array<variant>"), of_list)).otherwise(
        bind(F.from_json(payload, "map<string, variant>"), of_object)
    )


def parse_payloads(landing: DataFrame) -> DataFrame:
    """Landing rows of known providers with ``decoded`` items and ``well_formed``.

    Items of a payload that does not decode are not to be used.
    """
    known = landing.filter(F.col("provider").isin(*PROVIDERS))
    opened = known.withColumn("opened", _opened(F.col("payload"))).select(
        *landing.columns,
        F.coalesce("opened.items", _no_items()).alias("items"),
        F.col("opened.shaped").alias("shaped"),
    )
    decoded = opened.withColumn("decoded", _by_provider({
        "greenhouse": F.transform("items", _greenhouse),
        "ashby": F.transform("items", _ashby),
        "lever": F.transform("items", _lever),
    })).drop("items")
    typed = F.forall("decoded", lambda item: F.coalesce(item["ok"], F.lit(False)))
    return decoded.withColumn("well_formed", F.col("shaped") & typed).drop("shaped")


def quarantined(parsed: DataFrame) -> DataFrame:
    """Payloads that do not decode; only their company's fetch is lost."""
    return parsed.filter(~F.col("well_formed")).select("provider", "company", "payload")


def fetched_counts(parsed: DataFrame) -> DataFrame:
    """Postings per provider and company as delivered, unlisted ones included."""
    return (
        parsed.groupBy("provider", "company")
        .agg(F.sum(F.when(F.col("well_formed"), F.size("decoded"))).cast("bigint").alias("fetched"))
        .filter(F.col("fetched").isNotNull())
    )


def postings_of(parsed: DataFrame) -> DataFrame:
    """The bag of postings, with their keys. Duplicates stay."""
    postings = F.transform(F.filter("decoded", lambda item: item["listed"]), lambda item: item["posting"])
    # A filter here, or the one an inner explode implies, would be pushed below the
    # parsing and parse every payload twice. The null arrays fall out afterwards.
    usable = F.when(F.col("well_formed"), postings)
    exploded = parsed.select(F.explode_outer(usable).alias("posting")).filter(F.col("posting").isNotNull())
    return with_identity(exploded.select(*[F.col(f"posting.{name}") for name in _POSTING_FIELDS]))


def collect_boards(landing: DataFrame, sources: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Postings of every configured company whose provider is known.

    ``seen`` counts payloads, those in quarantine and the postings delivered, in the pass
    that decodes them.
    """
    wanted = sources.select("provider", "company").distinct()
    parsed = parse_payloads(landing.join(wanted, ["provider", "company"], "left_semi"))
    if seen is not None:
        delivered = F.when(F.col("well_formed"), F.size("decoded")).otherwise(0)
        parsed = parsed.observe(
            seen, F.count(F.lit(1)).alias("payloads"), F.count_if(~F.col("well_formed")).alias("quarantined"),
            F.coalesce(F.sum(delivered), F.lit(0)).cast("bigint").alias("fetched"),
        )
    return postings_of(parsed)


class Boards:
    """Collecting for a run: called for the postings, asked afterwards for its counts."""

    def __init__(self, landing: DataFrame, sources: DataFrame):
        self._landing, self._sources, self._seen = landing, sources, None

    def __call__(self) -> DataFrame:
        self._seen = Observation("boards")
        return collect_boards(self._landing, self._sources, self._seen)

    def counts(self) -> dict[str, int]:
        """What the pass over the payloads counted; it must have been run."""
        unknown = self._sources.filter(~F.col("provider").isin(*PROVIDERS)).count()
        return {**self._seen.get, "unknown_provider": unknown}

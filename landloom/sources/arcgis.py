"""ArcGIS feature-service source (Python DataSource API).

A layer whose size the server tells is dealt out in ranges of offsets, one input
partition each; other layers are one partition, paged to their end. The server
applies ``where``, the field list and the envelope.

Properties named in the option ``fields`` are columns. Filters on them reach the
server as part of its ``where`` (``spark.sql.python.filterPushdown.enabled`` must
be true), so pages hold only what can match; Spark applies them again,
since a server may compare text in its own way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from landloom.operators.indexing import dense_index
from landloom.sources.geojson import parse_features

DEFAULT_PAGE = 2000
PAGES_PER_PARTITION = 50
TIMEOUT_SEC = 30


def http_fetch(url: str) -> str:
    with urlopen(Request(url, headers={"Accept": "application/json"}), timeout=TIMEOUT_SEC) as reply:
        return reply.read().decode("utf-8")


def query_url(layer: str, where: str, out_fields: str, page: int, bounds=None, offset: int = 0, token: str = "") -> str:
    """Query URL; envelope, offset and token appear only when set."""
    url = f"{layer}/query?where={quote(where, safe='')}&outFields={quote(out_fields, safe='')}&f=geojson&resultRecordCount={page}"
    if bounds and bounds[2] > bounds[0] and bounds[3] > bounds[1]:
        envelope = ",".join(f"{float(b):f}" for b in bounds)
        url += f"&geometry={envelope}&" + urlencode(
            {"geometryType": "esriGeometryEnvelope", "spatialRel": "esriSpatialRelIntersects", "inSR": 4326}
        )
    if offset > 0:
        url += f"&resultOffset={offset}"
    return url + (f"&token={token}" if token else "")


COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Text patterns; the server's wildcards within the value must not count as such.
PATTERNS = {StringStartsWith: "{}%", StringEndsWith: "%{}", StringContains: "%{}%"}


def _literal(value) -> str | None:
    """A value as the server's SQL writes it; None for kinds that it is not sure to read alike."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value) if isinstance(value, int) or (isinstance(value, float) and value - value == 0) else None


def condition(filter_: Filter, names: set[str]) -> str | None:
    """The server's condition for a filter on one of the columns ``names``, or None.

    A condition may let rows through that the filter drops, never the other way round.
    """
    if isinstance(filter_, Not):
        inner = filter_.child
        # A server that ignores case would drop too much for text; NULL stays out on both sides for these kinds only.
        values = inner.value if isinstance(inner, In) else (inner.value,) if isinstance(inner, EqualTo) else (None,)
        said = None if any(isinstance(v, str) for v in values) else condition(inner, names)
        return said and f"NOT ({said})" if isinstance(inner, (EqualTo, In)) else None
    name = filter_.attribute[0] if len(filter_.attribute) == 1 else None
    if name not in names:
        return None
    kind = type(filter_)
    if kind in (IsNull, IsNotNull):
        return f"{name} IS {'NOT ' if kind is IsNotNull else ''}NULL"
    if kind is In:
        said = [_literal(v) for v in filter_.value]
        return f"{name} IN ({', '.join(said)})" if said and None not in said else None
    value = _literal(filter_.value)
    if value is None:
        return None
    if kind not in (EqualTo, EqualNullSafe, *PATTERNS) and isinstance(filter_.value, str):
        return None  # the order of text is the server's own
    if kind in COMPARED or kind is EqualNullSafe:
        return f"{name} {COMPARED.get(kind, '=')} {value}"
    if kind in PATTERNS and not set(filter_.value) & set("%_\\["):
        return f"{name} LIKE {_literal(PATTERNS[kind].format(filter_.value))}"
    return None


def _typed(value, kind: T.DataType):
    """A property as a value of the column; null where it is of another kind."""
    if isinstance(kind, T.StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value if isinstance(kind, T.BooleanType) and isinstance(value, bool) else None
    if isinstance(kind, T.IntegralType):
        return int(value) if value == int(value) else None
    return float(value) if isinstance(kind, T.FractionalType) else None


class _Span(InputPartition):
    """Offsets ``start`` to ``stop`` (None: to the end) of a layer."""

    def __init__(self, url: str, order: int, start: int, stop: int | None):
        super().__init__((url, start))
        self.url, self.order, self.start, self.stop = url, order, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str], str], fields: list[T.StructField]):
        self.options, self.fetch, self.fields, self.pushed = options, fetch, fields, []

    def _url(self, layer: str, offset: int) -> str:
        o, raw = self.options, self.options.get("bounds", "")
        bounds = [float(v) for v in raw.split(",")] if raw else None
        page = int(o.get("max_record_count", DEFAULT_PAGE))
        asked = o.get("where", "1=1")
        if self.pushed:
            asked = " AND ".join([*([f"({asked})"] if asked != "1=1" else []), *self.pushed])
        return query_url(layer, asked, o.get("out_fields", "*"), page, bounds, offset, o.get("token", ""))

    def _count(self, layer: str) -> int | None:
        """Features of a layer, if the server answers count queries."""
        try:
            return int(json.loads(self.fetch(self._url(layer, 0) + "&returnCountOnly=true"))["count"])
        except Exception:
            return None

    def partitions(self):
        urls = [self.options["url"], *[u for u in self.options.get("extra_layers", "").split(",") if u]]
        span = int(self.options.get("max_record_count", DEFAULT_PAGE)) * PAGES_PER_PARTITION
        out = []
        for i, url in enumerate(urls):
            n = self._count(url)
            starts = list(range(0, n, span)) or [0] if n is not None else [0]
            out += [_Span(url, i, s, e) for s, e in zip(starts, [*starts[1:], None])]
        return out

    def read(self, partition: _Span) -> Iterator[tuple]:
        page = int(self.options.get("max_record_count", DEFAULT_PAGE))
        offset = partition.start
        while partition.stop is None or offset < partition.stop:
            try:
                reply = json.loads(self.fetch(self._url(partition.url, offset)))
                features = reply["features"]
            except Exception:
                # Part of a layer is no result, unless asked for; a main layer must give a page.
                if self.options.get("partial", "fail") != "keep" or (offset == 0 and partition.order == 0):
                    raise
                return
            for i, feature in enumerate(features):
                if partition.stop is None or offset + i < partition.stop:
                    own = feature.get("properties") or {}
                    more_columns = [_typed(own.get(f.name), f.dataType) for f in self.fields]
                    yield partition.url, partition.order, offset + i, json.dumps(feature, ensure_ascii=False), *more_columns
            # A server with a smaller limit of its own says that there is more.
            more = reply.get("exceededTransferLimit") or (reply.get("properties") or {}).get("exceededTransferLimit")
            if not features or (len(features) < page and not more):
                return
            offset += len(features)


class _FilteringReader(_Reader):
    """Spark rejects a reader with this method while its setting is off, so plain reads do without."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what the server can narrow down; every filter is applied by Spark again."""
        names = {f.name for f in self.fields}
        for f in filters:
            said = condition(f, names)
            if said:
                self.pushed.append(said)
            yield f


class ArcGISFeatures(DataSource):
    """``spark.read.format("arcgis_features").option("url", ...)``.

    Options: ``url``, ``extra_layers`` (comma separated), ``where``,
    ``out_fields``, ``bounds`` (min_lon,min_lat,max_lon,max_lat), ``token``,
    ``fields`` (columns made of properties, as ``name type, ...``), ``push_filters``
    (``false`` to leave filters on them to Spark alone),
    ``max_record_count``, ``partial`` (``fail``, or ``keep`` to go on with what
    came before an error).
    """

    fetch: Callable[[str], str] = staticmethod(http_fetch)

    @classmethod
    def name(cls) -> str:
        return "arcgis_features"

    def schema(self) -> str:
        more = self.options.get("fields", "")
        return "source string, layer int, pos long, feature string" + (f", {more}" if more else "")

    def reader(self, schema) -> DataSourceReader:
        more = list(schema.fields[4:])
        kind = _FilteringReader if more and self.options.get("push_filters", "true") == "true" else _Reader
        return kind(dict(self.options), type(self).fetch, more)


def register(spark: SparkSession, fetch: Callable[[str], str] | None = None) -> None:
    """Register the source; ``fetch`` replaces the HTTP client (tests, proxies)."""
    source = ArcGISFeatures if fetch is None else type("ArcGISFeatures", (ArcGISFeatures,), {"fetch": staticmethod(fetch)})
    spark.dataSource.register(source)


def read_arcgis(spark: SparkSession, url: str, extra_layers: list[str] | None = None, only: Column | None = None, **options) -> DataFrame:
    """Features of one or more layers, appended without removing duplicates.

    ``only`` is a condition on the columns of the option ``fields``; what the server
    can test is asked of it. Ids are dense and follow layer and offset, the order
    in which later steps cut and merge.
    """
    reader = spark.read.format("arcgis_features").option("url", url)
    if extra_layers:
        reader = reader.option("extra_layers", ",".join(extra_layers))
    for key, value in options.items():
        reader = reader.option(key, ",".join(map(str, value)) if isinstance(value, (tuple, list)) else value)
    rows = reader.load()
    rows = rows if only is None else rows.where(only)
    bucket = [F.col("layer"), F.floor(F.col("pos") / 65536)]
    rows = dense_index(rows.select("source", "layer", "pos", "feature"), bucket, [F.col("pos")], "feature_id")
    return parse_features(rows.drop("pos", "layer"), parity="plugin")

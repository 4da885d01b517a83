"""Applying a stream of inserts, updates and deletes.

Changes are reduced to effects: one row per (owner, memory_id) that a payload writes or names in ``replaces``. The
effect of highest (seq, place) decides, so repeated, late and reordered deliveries don't matter. Each bucket - a hash of
owner *and* id, so a large owner is spread over all of them - is a folder of its own. To take effects in, a task loads
the bucket into an embedded DuckDB table and upserts: a conflict updates only if the incoming sequence is higher than the
stored one. Deletes stay as tombstones, or else an older write that arrives later would bring a memory back. Only
buckets that changes fall into are written anew; a manifest, which names the folder of every bucket, publishes all of
them at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.session import materialize
from lodequery.sources.manifest import ManifestFolder

EFFECTS = "owner string, memory_id string, seq bigint, place int, alive boolean, body string"
#: Keys a bucket should hold at most on average; a bucket's table must fit into a Python worker.
KEYS_A_BUCKET = 250_000
_MEMORY_LIMIT = "384MB"
_SLICE = 50_000
_ARROW = pa.schema(
    [("owner", pa.string()), ("memory_id", pa.string()), ("seq", pa.int64()), ("place", pa.int32()), ("alive", pa.bool_()), ("body", pa.string())]
)

# What the payloads of a batch do: each id that one writes, or names as a text or in a list, with the deciding effect.
_EFFECTS_OF = """
with raw as (
  select mem_owner as owner, seq, unnest(payloads) as body, unnest(range(len(payloads)))::integer as place from incoming
  where mem_owner is not null and seq is not null),
good as (select owner, seq, place, body, try_cast(body as json) as j from raw where body is not null and json_valid(body)),
effects as (
  select owner, json_extract_string(j, '$.memory_id') as memory_id, seq, place, true as alive, body from good
  where json_type(j, '$.type') = 'VARCHAR' and json_extract_string(j, '$.type') = 'memory' and json_type(j, '$.memory_id') = 'VARCHAR'
  union all
  select owner, unnest(case json_type(j, '$.replaces')
    when 'ARRAY' then list_transform(list_filter(json_extract(j, '$.replaces[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$'))
    when 'VARCHAR' then [json_extract_string(j, '$.replaces')] else [] end), seq, place, false, null
  from good where json_type(j) = 'OBJECT')
select owner, memory_id, t.seq, t.place, t.alive, t.body
from (select owner, memory_id, max(struct_pack(seq := seq, place := place, alive := alive, body := {body})) as t from effects group by all)
"""

_TABLE = """create table state (
  owner varchar, memory_id varchar, seq bigint, place integer, alive boolean, body varchar, primary key (owner, memory_id))"""
_UPSERT = """
insert into state
select owner, memory_id, seq, place, alive, body from incoming
qualify row_number() over (partition by owner, memory_id order by seq desc, place desc, alive desc, body desc nulls last) = 1
on conflict (owner, memory_id) do update
set seq = excluded.seq, place = excluded.place, alive = excluded.alive, body = excluded.body
where (excluded.seq, excluded.place, excluded.alive, coalesce(excluded.body, '')) > (state.seq, state.place, state.alive, coalesce(state.body, ''))
"""


def _connect():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": _MEMORY_LIMIT})


def _slices(con, sql: str) -> Iterator[pa.RecordBatch]:
    for part in con.sql(sql).fetch_record_batch(_SLICE):
        yield from pa.Table.from_batches([part]).cast(_ARROW).to_batches()


def memory_changes(log: DataFrame, with_body: bool = False) -> DataFrame:
    """Effects of a log with columns mem_owner, seq and payloads; extra columns are ignored.

    A payload that isn't a JSON object has none (NaN and Infinity are no JSON). Ids that aren't text have none either;
    ``replaces`` may be a list, one text, null or missing. A payload that names its own id has written it after all.
    Rows with a null owner, seq or payload list have no effect. Within an Arrow batch only the deciding effect of a key
    leaves the task, so a key that a third of all rows write costs no more than one row a batch in the shuffle.
    """
    sql = _EFFECTS_OF.format(body="body" if with_body else "null::varchar")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        try:
            for batch in batches:
                if batch.num_rows:
                    con.register("incoming", pa.Table.from_batches([batch]))
                    yield from _slices(con, sql)
                    con.unregister("incoming")
        finally:
            con.close()

    return log.select("mem_owner", F.col("seq").cast("long"), "payloads").mapInArrow(parse, EFFECTS)


def _upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their buckets, stored ones and changes in any order within; each bucket's table as it comes out."""
    con, current = _connect(), None

    def export() -> Iterator[pa.RecordBatch]:
        for part in _slices(con, "select owner, memory_id, seq, place, alive, body from state"):
            yield part.append_column("bucket", pa.array([current] * part.num_rows, pa.int32()))

    try:
        for batch in batches:
            own = batch.column("bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), own.size]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo and own[lo] != current:
                    if current is not None:
                        yield from export()
                    current = int(own[lo])
                    con.execute("drop table if exists state")
                    con.execute(_TABLE)
                if hi > lo:
                    con.register("incoming", pa.Table.from_batches([batch.slice(lo, hi - lo)]))
                    con.execute(_UPSERT)
                    con.unregister("incoming")
        if current is not None:
            yield from export()
    finally:
        con.close()


class ChangeFeed:
    """Current state of a changed table, tombstones included: owner, memory_id, seq, place, alive, body.

    The manifest holds the number of buckets, a bound of the keys and, of each version folder, the buckets that are
    valid there. When the buckets would hold more than KEYS_A_BUCKET keys, their number is doubled until they don't, and
    all are written anew; a number given by the caller stays.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.manifest = ManifestFolder(spark, f"{self.root}/manifest")

    def _known(self, version: int | None) -> dict:
        return json.loads(self.manifest.read(version)) if version else {"buckets": 0, "keys": 0, "folders": {}}

    def _read(self, known: dict, chosen: set[int] | None = None) -> DataFrame:
        paths = [f"{folder}/bucket={b}" for folder, own in known["folders"].items() for b in own if chosen is None or b in chosen]
        return self.spark.read.schema(EFFECTS).parquet(*paths) if paths else self.spark.createDataFrame([], EFFECTS)

    def state(self) -> DataFrame | None:
        """The published state; None before the first publication."""
        version = self.manifest.version()
        return self._read(self._known(version)) if version else None

    def publish(self, changes: DataFrame) -> DataFrame:
        """Take changes in, write the buckets they fall into, make them the state in one step, and return the state.

        A failure before the manifest is in place leaves the old state; the same changes can be applied again.
        """
        version = self.manifest.version() or 0
        known = self._known(version)
        effects = materialize(changes, "changes")  # they are counted first, and parsing them is dear
        keys = known["keys"] + effects.count()  # a bound: changes of stored keys count as new ones
        buckets = self.buckets or max(known["buckets"], int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        if not self.buckets and keys > buckets * KEYS_A_BUCKET and version:
            keys = self.state().count() + effects.count()
        while not self.buckets and keys > buckets * KEYS_A_BUCKET:
            buckets *= 2

        def bucket() -> Column:
            return F.pmod(F.xxhash64("owner", "memory_id"), F.lit(buckets)).cast("int")

        again = buckets != known["buckets"]
        changed = {r[0] for r in effects.select(bucket().alias("b")).distinct().collect()}  # at most a row a bucket
        before = self._read(known, None if again else changed)
        tasks = buckets if again else max(1, len(changed))
        placed = effects.unionByName(before).withColumn("bucket", bucket())
        placed = placed.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
        path = f"{self.root}/state-{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        placed.mapInArrow(_upsert, f"{EFFECTS}, bucket int").write.partitionBy("bucket").parquet(path)
        written = sorted(int(name[7:]) for name in self.manifest.beside(path) if name.startswith("bucket="))
        folders = {} if again else {f: left for f, own in known["folders"].items() if (left := [b for b in own if b not in changed])}
        self.manifest.publish(version + 1, json.dumps({"buckets": buckets, "keys": keys, "folders": folders | {path: written}}))
        return self.state()

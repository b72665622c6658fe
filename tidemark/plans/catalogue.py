"""Every query by name, with the SQL it must equal.

The history is derived from ``events`` and read through a snapshot at the fraction ``S`` of its transactions; ``H`` is
the vacuum horizon and ``LATE`` a snapshot shortly before the end. ``orders`` serves as an ordered map, ``documents`` and ``pages`` as tables of values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as kinds
from ..functions.visibility import Snapshot, visible_among
from ..operators import dml, history, recovery, scan, structure, vacuum
from ..operators.scan import Bound

#: Points of the history in 25ths of its last transaction id: a snapshot, the vacuum horizon, an older snapshot, the settled part.
S, H, EARLIER, SETTLED = 12, 10, 11, 20
#: A snapshot so many transactions before the end.
LATE = 60

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COMMON = """
WITH ops AS (
    SELECT event_id + 1 AS lsn, event_id // 4 + 1 AS txn_id, user_id AS k,
           CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, value AS v FROM events
), points AS (
    SELECT max(txn_id) AS last, max(txn_id) * {S} // 25 AS s, max(txn_id) * {H} // 25 AS h, max(txn_id) * {EARLIER} // 25 AS earlier, max(txn_id) * {SETTLED} // 25 AS settled, max(txn_id) - {LATE} AS late FROM ops
), clog AS (
    SELECT DISTINCT txn_id, CASE WHEN txn_id > (SELECT max(txn_id) FROM ops) - 5 THEN 'V' WHEN txn_id % 7 = 3 THEN 'A' ELSE 'C' END AS status FROM ops
), bad AS (
    SELECT txn_id FROM clog WHERE status <> 'C'
), versions AS (
    SELECT k, v, lsn, xmin, xmax FROM (
        SELECT k, v, lsn, op, txn_id AS xmin, coalesce(lead(txn_id) OVER (PARTITION BY k ORDER BY lsn), 0) AS xmax
        FROM ops WHERE txn_id NOT IN (SELECT txn_id FROM bad)
    ) WHERE op = 'P'
    UNION ALL
    SELECT k, v, lsn, txn_id, 0 FROM ops WHERE txn_id IN (SELECT txn_id FROM bad) AND op = 'P'
), log AS (
    SELECT (txn_id - 1) * 5 + (lsn - 1) % 4 + 1 AS lsn, txn_id, CASE WHEN op = 'P' THEN 'Insert' ELSE 'SetXMax' END AS rec_type, k, v FROM ops
    UNION ALL
    SELECT (txn_id - 1) * 5 + 5, txn_id, CASE WHEN status = 'C' THEN 'Commit' ELSE 'Abort' END, NULL, NULL FROM clog WHERE status <> 'V'
), visible AS (
    SELECT k, v, lsn, xmin, xmax FROM versions
    WHERE xmin < (SELECT s FROM points) AND xmin NOT IN (SELECT txn_id FROM bad) AND (xmax = 0 OR xmax >= (SELECT s FROM points) OR xmax IN (SELECT txn_id FROM bad))
), late AS (
    SELECT k, v, lsn, xmin, xmax FROM versions
    WHERE xmin < (SELECT late FROM points) AND xmin NOT IN (SELECT txn_id FROM bad) AND (xmax = 0 OR xmax >= (SELECT late FROM points) OR xmax IN (SELECT txn_id FROM bad))
), intents AS (
    SELECT c_custkey AS k, c_acctbal AS v FROM customer
), marked AS (
    SELECT v.*, a.status AS creator, b.status AS deleter FROM versions v LEFT JOIN clog a ON a.txn_id = v.xmin LEFT JOIN clog b ON b.txn_id = v.xmax
), dead AS (
    SELECT k, v, lsn, xmin, xmax FROM marked WHERE creator = 'A' OR (xmax <> 0 AND coalesce(deleter = 'C', false) AND xmax < (SELECT h FROM points))
)
""".replace("{S}", str(S)).replace("{LATE}", str(LATE)).replace("{H}", str(H)).replace("{EARLIER}", str(EARLIER)).replace("{SETTLED}", str(SETTLED))

FOOTPRINTS = """
WITH f AS (
    SELECT page_id, url, CAST(28 + octet_length(encode(url)) + CASE WHEN octet_length(encode(html)) > 2048 THEN 12 ELSE octet_length(encode(html)) END AS BIGINT) AS footprint FROM pages
), packed AS (
    SELECT *, CAST(floor(sum(footprint) OVER (ORDER BY url, page_id) / 4048) AS BIGINT) AS leaf FROM f
), leaves AS (
    SELECT leaf, count(*) AS n, CAST(sum(footprint) AS BIGINT) AS used, min(url) AS first_key FROM packed GROUP BY leaf
)
"""


class Tables:
    """The tables of a folder and what is derived from ``events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def map(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))

    @functools.cached_property
    def last(self) -> int:
        """The last transaction id: a maximum over one column, taken once."""
        return (self.events.agg(F.max("event_id")).first()[0] or 0) // 4 + 1

    def at(self, part: int) -> int:
        return self.last * part // 25

    @property
    def s(self) -> int:
        return self.at(S)

    @property
    def h(self) -> int:
        return self.at(H)

    @property
    def late(self) -> int:
        return self.last - LATE

    @property
    def ops(self) -> DataFrame:
        return history.operations(self.events)

    @property
    def clog(self) -> DataFrame:
        return history.with_status(self.ops.select("txn_id"), self.last).distinct()

    @property
    def marked(self) -> DataFrame:
        """All versions with the statuses of who made and who ended them."""
        return history.settled_versions(history.with_status(self.ops, self.last), 4 * self.last)

    @property
    def versions(self) -> DataFrame:
        return self.marked.select("k", "v", "lsn", "xmin", "xmax")

    def seen(self, bound: int, me: int = 0) -> DataFrame:  # ``me``: a transaction that also sees its own writes
        """(k, v, lsn, xmin) of what a snapshot sees. Later transactions can't change that, so they aren't read; ends after the bound don't show."""
        ops = history.operations(self.events, max(bound, me + 1))
        marked = history.settled_versions(history.with_status(ops, self.last), 4 * self.last, unsettled=bool(me))
        return visible_among(marked, bound, me or None).select("k", "v", "lsn", "xmin")

    @property
    def log(self) -> DataFrame:
        return history.log_records(self.ops, self.clog)

    def visible(self, bound: int | None = None) -> DataFrame:
        """With ends after the bound."""
        return visible_among(self.marked, bound)

    @property
    def intents(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))

    @property
    def footprints(self) -> DataFrame:
        return structure.footprints(self.pages, "url", "html").select("page_id", "url", "footprint")

    @property
    def packed(self) -> DataFrame:
        return structure.packed(self.footprints, ["url", "page_id"])

    @property
    def leaves(self) -> DataFrame:
        return structure.leaves(self.packed, "url")


def query(sql: str, common: str = ""):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        ORACLES[f.__name__] = common + sql
        return f

    return add


# --- Reads over the ordered map


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey = 4242")
def point_get(t):
    return scan.point(t.map, "k", 4242)


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey IN (SELECT c_custkey * 7919 % 15000 FROM customer WHERE c_custkey < 1000)")
def multi_get(t):
    return scan.many(t.map, "k", t.customer.where("c_custkey < 1000").select((F.col("c_custkey") * 7919 % 15000).alias("k")))


def _range(name: str, sql: str, low: Bound, high: Bound, **more) -> None:
    def f(t):
        return scan.scan(t.map, "k", low, high, **more)

    f.__name__ = name
    query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders " + sql)(f)


_range("range_ii", "WHERE o_orderkey BETWEEN 100 AND 200", Bound.included(100), Bound.included(200))
_range("range_ie", "WHERE o_orderkey >= 100 AND o_orderkey < 200", Bound.included(100), Bound.excluded(200))
_range("range_ei", "WHERE o_orderkey > 100 AND o_orderkey <= 200", Bound.excluded(100), Bound.included(200))
_range("range_ee", "WHERE o_orderkey > 100 AND o_orderkey < 200", Bound.excluded(100), Bound.excluded(200))
_range("range_from", "WHERE o_orderkey >= 14900", Bound.included(14900), Bound())
_range("range_to", "WHERE o_orderkey < 50", Bound(), Bound.excluded(50))
_range("full_scan", "", Bound(), Bound(), ordered=False)
_range("range_backward", "WHERE o_orderkey >= 100 AND o_orderkey < 200", Bound.included(100), Bound.excluded(200), backward=True)
_range("range_limit", "WHERE o_orderkey >= 777 ORDER BY o_orderkey LIMIT 25", Bound.included(777), Bound(), limit=25)
_range("range_backward_limit", "WHERE o_orderkey <= 5000 ORDER BY o_orderkey DESC LIMIT 25", Bound(), Bound.included(5000), backward=True, limit=25)


@query("SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def first_last_key(t):
    return scan.first_last(t.map, "k")


@query("SELECT count(*) AS rank FROM pages WHERE url < 'http://m'")
def lower_bound_rank(t):
    return scan.rank_of(t.pages, "url", "http://m")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000 ORDER BY c_custkey LIMIT 10")
def cli_select(t):
    return scan.select(t.customer, "c_custkey", where="c_acctbal > 9000", limit=10).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42 AND c_acctbal IS NOT NULL")
def cli_select_pk(t):
    return scan.select(t.customer, "c_custkey", pk=42, where="c_acctbal IS NOT NULL", limit=1).select("c_custkey", "c_name")


# --- Values


@query("""SELECT CASE WHEN b > 2048 THEN 'overflow' ELSE 'inline' END AS storage_class, CAST(CASE WHEN b > 2048 THEN ceil(b / 4048) ELSE 0 END AS BIGINT) AS chain_length, count(*) AS n
          FROM (SELECT octet_length(encode(text)) AS b FROM documents) GROUP BY ALL""")
def value_storage_class(t):
    size = F.octet_length("text")
    return t.documents.groupBy(kinds.storage_class(size).alias("storage_class"), kinds.chain_length(size).alias("chain_length")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4048) AS BIGINT) AS pages_to_free FROM documents WHERE octet_length(encode(text)) > 2048")
def orphan_chains(t):
    size = F.octet_length("text")
    return t.documents.where(kinds.is_overflow(size)).select("doc_id", kinds.chain_length(size).alias("pages_to_free"))


@query("SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority) AS checksum FROM orders")
def row_checksum(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").cast("binary")).alias("checksum"))


# --- Visibility


@query("SELECT k, v, lsn FROM visible", COMMON)
def visible_at_bound(t):
    return t.seen(t.s).select("k", "v", "lsn")


QUERIES["visible_at"], ORACLES["visible_at"] = QUERIES.pop("visible_at_bound"), ORACLES.pop("visible_at_bound")

OWN = """SELECT k, v, lsn FROM versions, points WHERE CASE WHEN xmax = s + 3 THEN false WHEN xmin = s + 3 THEN true
ELSE xmin < s AND xmin NOT IN (SELECT txn_id FROM bad) AND (xmax = 0 OR xmax >= s OR xmax IN (SELECT txn_id FROM bad)) END"""


@query(OWN, COMMON)
def visible_own(t):
    return t.seen(t.s, t.s + 3).select("k", "v", "lsn")


@query(f"SELECT * FROM ({OWN}) WHERE k = (SELECT min(k) FROM versions, points WHERE xmin = s + 3)", COMMON)
def point_get_own(t):
    key = t.seen(t.s, t.s + 3).where(F.col("xmin") == t.s + 3).agg(F.min("k").alias("k"))
    return scan.many(t.seen(t.s, t.s + 3).select("k", "v", "lsn"), "k", key)


@query("SELECT k, v, lsn FROM versions WHERE xmin NOT IN (SELECT txn_id FROM bad) AND (xmax = 0 OR xmax IN (SELECT txn_id FROM bad))", COMMON)
def visible_latest(t):
    return t.visible().select("k", "v", "lsn")


@query("SELECT count(*) AS n FROM visible", COMMON)
def scan_count(t):
    return t.seen(t.s).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM marked WHERE creator = 'A'", COMMON)
def aborted_invisible(t):
    return t.marked.where("creator = 'A'").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM visible JOIN clog ON xmin = txn_id WHERE status = 'A'", COMMON)
def aborted_seen(t):
    """What the rule forbids: versions of aborted transactions that the snapshot sees. Its one row says 0."""
    return t.seen(t.s).join(t.clog.where("status = 'A'"), F.col("xmin") == F.col("txn_id"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT k, v, lsn, xmin, CASE WHEN xmin >= earlier THEN 'created' ELSE 'ended' END AS change FROM versions, points
WHERE xmin < s AND xmin NOT IN (SELECT txn_id FROM bad) AND (xmin >= earlier) <> (xmax >= earlier AND xmax < s)""", COMMON)
def snapshot_diff(t):
    """Between an earlier snapshot and ``s``: what only the later one sees, and what only the earlier one sees (removed keys too)."""
    a, b = t.at(EARLIER), t.s
    made = F.col("xmin") >= a
    ended = (F.col("xmax") >= a) & (F.col("xmax") < b)
    rows = t.marked.where((F.col("xmin") < b) & (F.col("creator") == "C") & (made != ended))
    return rows.select("k", "v", "lsn", "xmin", F.when(made, "created").otherwise("ended").alias("change"))


@query("SELECT k, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM versions GROUP BY k", COMMON)
def version_runs(t):
    return t.versions.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


@query("SELECT k, count(*) AS n FROM visible GROUP BY k HAVING count(*) > 1", COMMON)
def single_visible_invariant(t):
    return t.seen(t.s).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT txn_id, txn_id = 0 OR (txn_id < s AND NOT txn_id BETWEEN s - 10 AND s - 1 AND status <> 'A') AS committed FROM clog, points WHERE txn_id BETWEEN s - 20 AND s + 10""", COMMON)
def snapshot_committed(t):
    snap = Snapshot(t.s - 10, t.s, frozenset(range(t.s - 10, t.s)))
    rows = t.clog.where(F.col("txn_id").between(t.s - 20, t.s + 10))
    return rows.select("txn_id", (snap.committed(F.col("txn_id")) & (F.col("status") != "A")).alias("committed"))


@query("SELECT txn_id, txn_id <> 0 AND status = 'V' AND txn_id >= last - 10 AS in_progress FROM clog, points WHERE txn_id >= last - 20", COMMON)
def snapshot_in_progress(t):
    snap = Snapshot(t.last - 10, t.last - 2, frozenset(range(t.last - 10, t.last - 2)))
    return t.clog.where(F.col("txn_id") >= t.last - 20).select("txn_id", snap.in_progress(F.col("txn_id"), F.col("status") != "V").alias("in_progress"))


@query("SELECT coalesce(min(CASE WHEN status = 'V' THEN txn_id END), max(txn_id) + 1) AS xmin, max(txn_id) + 1 AS xmax, count(*) FILTER (status = 'V') AS n_active FROM clog", COMMON)
def snapshot_of_clog(t):
    active = F.when(F.col("status") == "V", F.col("txn_id"))
    return t.clog.agg(F.coalesce(F.min(active), F.max("txn_id") + 1).alias("xmin"), (F.max("txn_id") + 1).alias("xmax"), F.count(active).alias("n_active"))


# --- Writes


@query("SELECT i.k, i.v FROM intents i WHERE k NOT IN (SELECT k FROM visible)", COMMON)
def insert_accept(t):
    return dml.accepted_inserts(t.intents, t.seen(t.s))


@query("SELECT i.k, i.v FROM intents i WHERE k IN (SELECT k FROM visible)", COMMON)
def insert_duplicate(t):
    return dml.duplicate_inserts(t.intents, t.seen(t.s))


@query("SELECT i.k, v.v AS old_value, i.v AS new_value FROM intents i JOIN visible v ON i.k = v.k", COMMON)
def update_apply(t):
    return dml.applied_updates(t.intents, t.seen(t.s))


@query("SELECT i.k, i.v FROM intents i WHERE k NOT IN (SELECT k FROM visible)", COMMON)
def update_missing(t):
    return dml.missing_keys(t.intents, t.seen(t.s))


@query("SELECT i.k, i.v FROM intents i WHERE k IN (SELECT k FROM visible)", COMMON)
def delete_apply(t):
    return dml.applied_deletes(t.intents, t.seen(t.s))


@query("SELECT i.k, i.v FROM intents i WHERE k NOT IN (SELECT k FROM visible)", COMMON)
def delete_missing(t):
    return dml.missing_keys(t.intents, t.seen(t.s))


@query("""WITH c AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT 'ok' AS outcome, count(*) AS n FROM c UNION ALL SELECT 'DuplicateKey', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM c""")
def insert_outcomes(t):
    return dml.insert_outcomes(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT CASE WHEN k IN (SELECT k FROM visible) THEN 'ok' ELSE 'KeyNotFound' END AS outcome, count(*) AS n FROM intents GROUP BY 1", COMMON)
def update_outcomes(t):
    found = t.intents.join(t.seen(t.s).select("k", F.lit("ok").alias("_ok")), "k", "left")
    return found.groupBy(F.coalesce("_ok", F.lit("KeyNotFound")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN xmax = 0 THEN 'ok' WHEN status = 'V' THEN 'WaitFor' WHEN status = 'A' THEN 'ok' ELSE 'WriteConflict' END AS verdict, count(*) AS n
FROM visible LEFT JOIN clog ON xmax = txn_id GROUP BY 1""", COMMON)
def conflict_write(t):
    return t.visible(t.s).groupBy(dml.write_verdict(F.col("xmax"), F.col("deleter")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN status = 'V' THEN 'WaitFor' WHEN status = 'C' THEN 'WriteConflict' ELSE 'ok' END AS verdict, count(*) AS n
FROM late LEFT JOIN (SELECT k, arg_min(status, lsn) AS status FROM ops JOIN clog USING (txn_id) WHERE txn_id >= (SELECT late FROM points) GROUP BY k) USING (k) GROUP BY 1""", COMMON)
def conflict_write_next(t):
    later = history.with_status(t.ops.where(F.col("txn_id") >= t.late), t.last).groupBy("k").agg(F.min_by("status", "lsn").alias("status"))
    met = t.seen(t.late).join(later, "k", "left")
    verdict = F.when(F.col("status") == "V", "WaitFor").when(F.col("status") == "C", "WriteConflict").otherwise("ok")
    return met.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN k IN (SELECT k FROM marked WHERE creator = 'V') THEN 'WaitFor' WHEN k IN (SELECT k FROM late) THEN 'DuplicateKey' ELSE 'ok' END AS verdict, count(*) AS n
FROM intents GROUP BY 1""", COMMON)
def conflict_insert(t):
    waits = history.with_status(t.ops.where(F.col("txn_id") > t.last - 5), t.last).where("status = 'V' AND op = 'P'").select("k", F.lit(2).alias("p"))
    met = waits.unionByName(t.seen(t.late).select("k", F.lit(1).alias("p"))).groupBy("k").agg(F.max("p").alias("p"))
    verdict = F.when(F.col("p") == 2, "WaitFor").when(F.col("p") == 1, "DuplicateKey").otherwise("ok")
    return t.intents.join(met, "k", "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN b.tid > a.tid THEN 'die' ELSE 'wait' END AS verdict, count(*) AS n
FROM (SELECT txn_id * 7919 % 100003 AS tid, k, lsn FROM ops) a JOIN (SELECT txn_id * 7919 % 100003 AS tid, k, lsn FROM ops) b
ON a.k = b.k AND b.lsn > a.lsn AND b.lsn <= a.lsn + 40 AND a.tid <> b.tid GROUP BY 1""", COMMON)
def wait_die(t):
    claims = t.ops.select((F.col("txn_id") * 7919 % 100003).alias("tid"), "k", "lsn")
    return dml.claim_conflicts(claims, 40).groupBy(dml.wait_or_die(F.col("me"), F.col("holder")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# --- Horizon and vacuum


@query("SELECT coalesce(min(CASE WHEN status = 'V' THEN txn_id END), max(txn_id) + 1) AS global_xmin FROM clog", COMMON)
def global_xmin(t):
    return vacuum.global_xmin(t.clog)


@query("""SELECT i.txn_id, coalesce(c.status, CASE WHEN i.txn_id < (SELECT min(txn_id) FROM clog WHERE status = 'V') THEN 'C' ELSE 'V' END) AS status
FROM (SELECT unnest([10, last - 2, last * 4]) AS txn_id FROM points) i LEFT JOIN (SELECT clog.* FROM clog, points WHERE txn_id >= h) c USING (txn_id)""", COMMON)
def settled_status(t):
    ids = t.spark.createDataFrame([(10,), (t.last - 2,), (t.last * 4,)], "txn_id long")
    return vacuum.settled_status(ids, t.clog.where(F.col("txn_id") >= t.h), vacuum.global_xmin(t.clog))


@query("SELECT max(lsn) - min(CASE WHEN status = 'V' THEN lsn END) AS age FROM ops JOIN clog USING (txn_id)", COMMON)
def oldest_active(t):
    return history.with_status(t.ops, t.last).agg((F.max("lsn") - F.min(F.when(F.col("status") == "V", F.col("lsn")))).alias("age"))


@query("SELECT k, lsn, xmin, xmax FROM dead", COMMON)
def vacuumable(t):
    return vacuum.split_versions(t.marked, t.h)[0].select("k", "lsn", "xmin", "xmax")


@query("SELECT count(*) AS n FROM dead", COMMON)
def vacuum_count(t):
    return vacuum.split_versions(t.marked, t.h)[0].agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, v, lsn, xmin, xmax FROM versions EXCEPT ALL SELECT k, v, lsn, xmin, xmax FROM dead", COMMON)
def compacted_versions(t):
    return vacuum.split_versions(t.marked, t.h)[1].select("k", "v", "lsn", "xmin", "xmax")


@query("""SELECT batch, count(*) AS scanned, count(*) FILTER (is_dead) AS dead FROM (
SELECT (row_number() OVER (ORDER BY k, lsn) - 1) // 512 AS batch, lsn IN (SELECT lsn FROM dead) AS is_dead FROM versions) GROUP BY batch""", COMMON)
def vacuum_batches(t):
    marked = t.marked.select("k", "lsn", vacuum.is_vacuumable(t.h).alias("dead"))
    rows = structure.numbered(marked, ["k", "lsn"])
    return rows.groupBy(F.expr("(rn - 1) div 512").alias("batch")).agg(F.count(F.lit(1)).alias("scanned"), F.count_if("dead").alias("dead"))


@query("SELECT k FROM versions GROUP BY k EXCEPT SELECT k FROM marked WHERE NOT (creator = 'A' OR (xmax <> 0 AND coalesce(deleter = 'C', false)))", COMMON)
def empty_leaves(t):
    return t.marked.groupBy("k").agg(F.min(vacuum.is_vacuumable(None)).alias("_all")).where("_all").select("k")


@query("""SELECT k, max(xmax) AS stamp FROM marked WHERE creator <> 'A' GROUP BY k
HAVING min(xmax) > 0 AND max(xmax) < (SELECT min(txn_id) FROM clog WHERE status = 'V')""", COMMON)
def recyclable(t):
    """Keys of which, aborted versions left aside, every version is ended, stamped with the last end; free once that is below all ids in flight."""
    found = t.marked.where("creator <> 'A'").groupBy("k").agg(F.min("xmax").alias("_least"), F.max("xmax").alias("stamp"))
    return found.where((F.col("_least") > 0) & (F.col("stamp") < t.last - 4)).select("k", "stamp")


@query("SELECT k FROM (SELECT unnest(range(0, 200)) AS k) WHERE k NOT IN (SELECT k FROM visible)", COMMON)
def free_ids(t):
    return t.spark.range(200).select(F.col("id").alias("k")).join(t.seen(t.s), "k", "left_anti")


@query("SELECT count(*) AS n FROM versions WHERE xmax <> 0", COMMON)
def dead_version_count(t):
    return t.versions.where("xmax <> 0").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT txn_id, status FROM clog, points WHERE status = 'V' OR (status = 'C' AND txn_id >= settled) OR (status = 'A' AND txn_id >= h)", COMMON)
def clog_truncate(t):
    return vacuum.truncated(t.clog, t.at(SETTLED), t.h)


@query("""SELECT sweep, count(*) AS n, min(xmax) AS first_xmax, max(xmax) AS last_xmax FROM (
SELECT xmax, (row_number() OVER (ORDER BY xmax, k, lsn) - 1) // 1000 AS sweep FROM versions WHERE xmax <> 0) GROUP BY sweep""", COMMON)
def autovacuum_trigger(t):
    rows = structure.numbered(t.versions.where("xmax <> 0"), ["xmax", "k", "lsn"])
    return rows.groupBy(F.expr("(rn - 1) div 1000").alias("sweep")).agg(F.count(F.lit(1)).alias("n"), F.min("xmax").alias("first_xmax"), F.max("xmax").alias("last_xmax"))


# --- Log, recovery, checkpoint


@query("SELECT lsn, txn_id, rec_type, k, v FROM log WHERE lsn BETWEEN 100 AND 160", COMMON)
def log_scan(t):
    return t.log.where("lsn BETWEEN 100 AND 160")


@query("SELECT rec_type, count(*) AS n FROM log GROUP BY rec_type", COMMON)
def log_type_histogram(t):
    return t.log.groupBy("rec_type").agg(F.count(F.lit(1)).alias("n"))


SEGMENTS = "SELECT (lsn - 1) // 1000 AS segment, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS n FROM log GROUP BY 1"


@query(SEGMENTS, COMMON)
def log_segments(t):
    return recovery.segments(t.log, 1000)


@query(f"SELECT segment, first_lsn, last_lsn, n FROM (SELECT *, lead(first_lsn) OVER (ORDER BY segment) AS nxt FROM ({SEGMENTS})) WHERE nxt <= (SELECT s * 5 + 1 FROM points)", COMMON)
def log_reclaim(t):
    return recovery.reclaimable(recovery.segments(t.log, 1000), t.s * 5 + 1)


@query("SELECT count(*) AS n, max(lsn) AS last_lsn FROM log WHERE lsn < coalesce((SELECT min(lsn) FROM log WHERE lsn % 4999 = 0), 9223372036854775807)", COMMON)
def log_valid_prefix(t):
    return recovery.valid_prefix(t.log, F.col("lsn") % 4999 == 0).agg(F.count(F.lit(1)).alias("n"), F.max("lsn").alias("last_lsn"))


@query("SELECT txn_id, CASE WHEN arg_max(rec_type, lsn) = 'Commit' THEN 'C' ELSE 'A' END AS status FROM log WHERE rec_type IN ('Commit', 'Abort') GROUP BY txn_id", COMMON)
def clog_rebuild(t):
    return recovery.rebuilt_statuses(t.log)


@query("SELECT DISTINCT txn_id FROM log WHERE txn_id NOT IN (SELECT txn_id FROM log WHERE rec_type IN ('Commit', 'Abort'))", COMMON)
def crash_victims(t):
    return recovery.crash_victims(t.log)


@query("SELECT max(txn_id) + 1 AS next_txn_id, max(lsn) + 1 AS next_lsn FROM log", COMMON)
def watermarks(t):
    return recovery.watermarks(t.log)


REDO = """SELECT k, v FROM (SELECT k, v, rec_type, row_number() OVER (PARTITION BY k ORDER BY lsn DESC) AS r FROM log
WHERE rec_type IN ('Insert', 'SetXMax') AND txn_id IN (SELECT txn_id FROM log WHERE rec_type = 'Commit')) WHERE r = 1 AND rec_type = 'Insert'"""


@query(REDO, COMMON)
def redo_state(t):
    return recovery.redo_state(t.log)


@query(REDO, COMMON)
def recover_from_checkpoint(t):
    return recovery.from_checkpoint(t.seen(t.s).select("k", "v", ((F.col("xmin") - 1) * 5).alias("lsn")), t.log.where(F.col("txn_id") >= t.s))


@query("SELECT txn_id FROM clog, points WHERE status = 'A' AND txn_id >= h", COMMON)
def pinned_aborted(t):
    return t.clog.where((F.col("status") == "A") & (F.col("txn_id") >= t.h)).select("txn_id")


@query("SELECT (SELECT min(lsn) FROM log WHERE txn_id >= s) AS redo_point, s AS next_txn_id, (SELECT count(*) FROM clog WHERE status = 'A' AND txn_id >= h AND txn_id < s) AS n_pinned FROM points", COMMON)
def checkpoint_row(t):
    pinned = t.clog.where((F.col("status") == "A") & (F.col("txn_id") >= t.h) & (F.col("txn_id") < t.s)).agg(F.count(F.lit(1)).alias("n_pinned"))
    redo = t.log.where(F.col("txn_id") >= t.s).agg(F.min("lsn").alias("redo_point"))
    return redo.join(F.broadcast(pinned)).select("redo_point", F.lit(t.s).cast("long").alias("next_txn_id"), "n_pinned")


#: First and last record of each transaction; one in flight has no end. A checkpoint every 1000 positions.
OPEN_AT = """SELECT c AS checkpoint, coalesce(min(first), c + 1) AS redo_point FROM (SELECT DISTINCT lsn // 1000 * 1000 AS c FROM log WHERE lsn >= 1000)
LEFT JOIN (SELECT txn_id, min(lsn) AS first, max(CASE WHEN rec_type IN ('Commit', 'Abort') THEN lsn END) AS fin FROM log GROUP BY txn_id) x
ON x.first <= c AND coalesce(x.fin, 9223372036854775807) > c GROUP BY c"""


def _redo_points(t):
    """Transactions end within five positions of their start, so each spans at most one checkpoint; one in flight spans those up to the end."""
    last = t.log.agg(F.max("lsn").alias("_last"))
    spans = t.log.groupBy("txn_id").agg(F.min("lsn").alias("first"), F.max(F.when(F.col("rec_type").isin("Commit", "Abort"), F.col("lsn"))).alias("fin")).join(F.broadcast(last))
    low = F.expr("((first + 999) div 1000) * 1000")
    high = F.least(F.coalesce(F.col("fin") - 1, F.col("_last")), F.col("_last"))
    open_ = spans.withColumn("_low", low).withColumn("_high", high).where("_low <= _high AND _low >= 1000").select("first", F.explode(F.sequence("_low", "_high", F.lit(1000).cast("long"))).alias("checkpoint"))
    checkpoints = t.log.where("lsn >= 1000").select(F.expr("lsn div 1000 * 1000").alias("checkpoint")).distinct()
    return checkpoints.join(open_.groupBy("checkpoint").agg(F.min("first").alias("first")), "checkpoint", "left").select("checkpoint", F.coalesce("first", F.col("checkpoint") + 1).alias("redo_point"))


@query(OPEN_AT, COMMON)
def redo_point(t):
    return _redo_points(t)


@query(f"SELECT checkpoint, redo_point, coalesce(lag(redo_point) OVER (ORDER BY checkpoint) = redo_point, false) AS stalled FROM ({OPEN_AT})", COMMON)
def redo_stall(t):
    return structure.checkpoint_stalls(_redo_points(t), 1000)


# --- Structure


@query("SELECT page_id, footprint FROM f", FOOTPRINTS)
def record_footprint(t):
    return t.footprints.select("page_id", "footprint")


@query("SELECT leaf, n, used FROM leaves", FOOTPRINTS)
def leaf_packing(t):
    return t.leaves.select("leaf", "n", "used")


@query("SELECT leaf, first_key FROM leaves", FOOTPRINTS)
def separators(t):
    return t.leaves.select("leaf", "first_key")


@query("""SELECT leaf, used FROM (SELECT leaf, CAST(sum(footprint) FILTER (page_id % 8 < 3) AS BIGINT) AS used FROM packed GROUP BY leaf) WHERE coalesce(used, 0) * 2 < 4048""", FOOTPRINTS)
def underfull_leaves(t):
    """Leaves less than half full after deletes that leave three pages of eight (a packing alone leaves none)."""
    used = t.packed.groupBy("leaf").agg(F.sum(F.when(F.col("page_id") % 8 < 3, F.col("footprint"))).cast("long").alias("used"))
    return used.where(F.coalesce("used", F.lit(0)) * 2 < 4048).select("leaf", "used")


@query("SELECT page_id, (SELECT count(*) FROM leaves WHERE first_key <= url) AS child FROM pages", FOOTPRINTS)
def child_route(t):
    return structure.routed(t.pages.select("page_id", "url"), "url", t.leaves, "first_key", "child").select("page_id", "child")


@query("SELECT o_orderkey % 8 AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_histogram(t):
    return structure.shard_histogram(t.map, "k")

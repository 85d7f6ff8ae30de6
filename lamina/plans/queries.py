"""Every operator as a named query over the driver's tables, next to the SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Domain, sql
from ..functions import hashing, paths
from ..operators import changes, content, diff, listing, retention, state, sync, tree
from ..scratch import materialize
from ..streaming import debounce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Parameters of the queries: a repository, two of its snapshots, a store pair, a path.
REPO, LEFT, RIGHT = 0, 10, 20
SOURCE, TARGET = 1, 2
PATH_USER = 4


def query(body: str | None, *more: str):
    """Registers a function of the domain under its name, with its SQL."""

    def register(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if body is not None:
            ORACLE[f.__name__] = sql(body, *more)
        return f

    return register


def day_state(entries: DataFrame, day: int) -> DataFrame:
    """Present paths of all repositories at a day of the year; a snapshot's id ends in its day."""
    return state.latest(entries.where(F.col("snapshot_id") % 1000 <= day)).where("status = 1")


def state_sql(name: str, day: int) -> str:
    return f"""{name} AS (SELECT repository_id, path, object_id, mtime FROM (
      SELECT e.*, row_number() OVER (PARTITION BY repository_id, path ORDER BY snapshot_id DESC) AS rn FROM f_entries e WHERE snapshot_id % 1000 <= {day}) x WHERE rn = 1 AND status = 1)"""


def repo_state_sql(name: str, snapshot: int) -> str:
    return f"""{name} AS (SELECT path, object_id, mtime, snapshot_id FROM (
      SELECT e.*, row_number() OVER (PARTITION BY path ORDER BY snapshot_id DESC) AS rn FROM f_entries e WHERE repository_id = {REPO} AND snapshot_id <= {snapshot}) x WHERE rn = 1 AND status = 1)"""


STATES = (repo_state_sql("a", LEFT), repo_state_sql("b", RIGHT))


# ---- domain tables

@query("SELECT repository_id, snapshot_id, path, status, object_id, mtime FROM f_observations")
def domain_observations(d: Domain) -> DataFrame:
    return d.observations


@query("SELECT object_id, digest, size FROM f_objects")
def domain_objects(d: Domain) -> DataFrame:
    return d.objects


@query("SELECT snapshot_id, repository_id, created_at FROM f_snapshots")
def domain_snapshots(d: Domain) -> DataFrame:
    return d.snapshots.drop("parent_id")


@query("SELECT snapshot_id, repository_id, created_at, parent_id FROM f_snapshots")
def snapshot_parent_chain(d: Domain) -> DataFrame:
    return d.snapshots


# ---- changes

@query("SELECT repository_id, snapshot_id, path, status, object_id, mtime, change FROM f_changes")
def change_classification(d: Domain) -> DataFrame:
    return d.changes


COUNTERS = """SELECT repository_id, snapshot_id, count(*) FILTER (WHERE status = 1) AS scanned, count(*) FILTER (WHERE change = 'added') AS added,
  count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'deleted') AS deleted
FROM f_changes GROUP BY repository_id, snapshot_id"""


@query(COUNTERS)
def scan_counters(d: Domain) -> DataFrame:
    return changes.counters(d.changes)


@query("SELECT snapshot_id, repository_id, created_at FROM f_snapshots WHERE snapshot_id IN (SELECT snapshot_id FROM f_entries WHERE path LIKE 'd3/%')")
def empty_snapshot_discard(d: Domain) -> DataFrame:
    """As if only d3/ were watched: most snapshots have no change there and are discarded."""
    return changes.keep_nonempty(d.snapshots.drop("parent_id"), d.entries.where(F.col("path").startswith("d3/")))


WALKED = (
    state_sql("old", 12),
    state_sql("new", 15),
    "c AS (SELECT old.*, o.size, o.digest FROM old JOIN f_objects o ON old.object_id = o.object_id)",
    "w AS (SELECT new.*, o.size, o.digest FROM new JOIN f_objects o ON new.object_id = o.object_id)",
)


def _cached(d: Domain, day: int) -> DataFrame:
    return day_state(d.entries, day).join(d.objects, "object_id")


STATUS = """SELECT coalesce(w.repository_id, c.repository_id) AS repository_id, coalesce(w.path, c.path) AS path,
  CASE WHEN w.path IS NULL THEN 'deleted' WHEN c.path IS NULL THEN 'added' WHEN {differs} THEN 'modified' ELSE 'unmodified' END AS state
FROM w FULL OUTER JOIN c ON w.repository_id = c.repository_id AND w.path = c.path"""


@query(STATUS.format(differs="w.size <> c.size OR w.mtime <> c.mtime"), *WALKED)
def status_fast(d: Domain) -> DataFrame:
    return changes.status_fast(_cached(d, 15), _cached(d, 12))


@query(STATUS.format(differs="w.digest <> c.digest"), *WALKED)
def status_hash(d: Domain) -> DataFrame:
    return changes.status_hash(_cached(d, 15), _cached(d, 12))


@query("""SELECT c.repository_id, c.path, CASE WHEN w.path IS NULL THEN 'MISSING' WHEN w.digest = c.digest THEN 'OK' ELSE 'MODIFIED' END AS result
FROM c LEFT JOIN w ON w.repository_id = c.repository_id AND w.path = c.path""", *WALKED)
def verify_digests(d: Domain) -> DataFrame:
    return changes.verify(_cached(d, 12), _cached(d, 15))


@query(f"""SELECT coalesce(w.path, c.path) AS path,
  CASE WHEN w.path IS NULL THEN 'deleted' WHEN c.path IS NULL THEN 'added' WHEN (w.size = c.size AND w.mtime = c.mtime) OR w.object_id = c.object_id THEN 'unchanged' ELSE 'modified' END AS change,
  coalesce(w.object_id = c.object_id AND NOT (w.size = c.size AND w.mtime = c.mtime), false) AS refresh_mtime
FROM (SELECT * FROM w WHERE repository_id = {REPO}) w FULL OUTER JOIN (SELECT * FROM c WHERE repository_id = {REPO}) c ON w.path = c.path""", *WALKED)
def scan_against_cache(d: Domain) -> DataFrame:
    """The object id stands in for the fast digest."""
    rows = lambda day: _cached(d, day).where(F.col("repository_id") == REPO).withColumn("fast_digest", F.col("object_id"))
    return changes.scan_against_cache(rows(15).select("path", "size", "mtime", "fast_digest"), rows(12))


# ---- state and references

@query("SELECT repository_id, path, snapshot_id, status, object_id, mtime, depth FROM f_entry_cache")
def entry_cache_latest(d: Domain) -> DataFrame:
    return d.cache


@query("SELECT path, object_id, mtime, snapshot_id FROM b", *STATES)
def state_as_of(d: Domain) -> DataFrame:
    return state.as_of(d.entries, RIGHT).select("path", "object_id", "mtime", "snapshot_id")


@query("""SELECT repository_id, snapshot_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM f_snapshots) x WHERE rn = 4""")
def snapshot_ref_latest_n(d: Domain) -> DataFrame:
    return state.nth_latest(d.snapshots, 3).select("repository_id", "snapshot_id", "created_at")


@query("""SELECT repository_id, snapshot_id FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM f_snapshots WHERE created_at <= TIMESTAMP '2024-01-17 23:59:59') x WHERE rn = 1""")
def snapshot_ref_before(d: Domain) -> DataFrame:
    return state.resolve(d.snapshots, "@2024-01-17")


@query(f"SELECT snapshot_id, repository_id, created_at FROM f_snapshots WHERE created_at > (SELECT created_at FROM f_snapshots WHERE snapshot_id = {RIGHT})")
def snapshots_after(d: Domain) -> DataFrame:
    return state.after(d.snapshots.drop("parent_id"), RIGHT)


# ---- listings

@query("""SELECT s.repository_id, s.snapshot_id, s.created_at, concat('+', c.added, ' ~', c.modified, ' -', c.deleted) AS summary
FROM (SELECT * FROM f_snapshots WHERE created_at > TIMESTAMP '2024-01-05 00:00:00' AND created_at < TIMESTAMP '2024-01-25 23:59:59' ORDER BY created_at DESC, snapshot_id DESC LIMIT 25) s
LEFT JOIN c ON s.snapshot_id = c.snapshot_id AND s.repository_id = c.repository_id""", f"c AS ({COUNTERS})")
def log_range_limit(d: Domain) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return listing.log(d.snapshots, changes.counters(d.changes), after=at("2024-01-05 00:00:00"), before=at("2024-01-25 23:59:59"), limit=25)


@query(f"""SELECT e.path, CASE WHEN e.status = 1 THEN 'present' ELSE 'deleted' END AS state, e.object_id, coalesce(substring(o.digest, 1, 12), '------------') AS digest, o.size, e.depth
FROM f_entries e LEFT JOIN f_objects o ON e.object_id = o.object_id WHERE e.snapshot_id = {RIGHT}""")
def show_snapshot(d: Domain) -> DataFrame:
    return listing.show(d.entries, d.objects, RIGHT)


@query(f"SELECT path, object_id, mtime FROM f_entry_cache WHERE repository_id = {REPO} AND status = 1 AND starts_with(path, 'd2/s')")
def files_prefix(d: Domain) -> DataFrame:
    return listing.files(d.cache, REPO, "d2/s").select("path", "object_id", "mtime")


@query(f"SELECT path, object_id, mtime FROM f_entry_cache WHERE repository_id = {REPO} AND status = 1 AND starts_with(path, 'd4/s2/') AND depth = 2")
def files_dir_children(d: Domain) -> DataFrame:
    return listing.children(d.cache, REPO, "/d4/s2").select("path", "object_id", "mtime")


@query(f"""SELECT path, object_id, total, greatest(1, cast(ceil(total / 20.0) AS bigint)) AS pages FROM (
  SELECT path, object_id, count(*) OVER () AS total FROM f_entry_cache WHERE repository_id = {REPO} AND status = 1) x ORDER BY path LIMIT 20 OFFSET 20""")
def files_page_total(d: Domain) -> DataFrame:
    return listing.page(listing.files(d.cache, REPO).select("path", "object_id"), page=2, per_page=20)


@query(f"""SELECT split_part(path, '/', 1) AS name, count(*) AS n_files FROM f_entry_cache WHERE repository_id = {REPO} AND status = 1 AND depth > 0 GROUP BY 1""")
def subdirs_fallback(d: Domain) -> DataFrame:
    return listing.subdirectories(d.cache, REPO, "")


@query(f"""SELECT e.snapshot_id, s.created_at, CASE WHEN e.status = 0 THEN 'D' WHEN e.change = 'added' THEN 'A' ELSE 'M' END AS action, e.object_id,
  coalesce(substring(o.digest, 1, 12), '------------') AS digest, o.size
FROM f_entries e JOIN f_snapshots s ON e.snapshot_id = s.snapshot_id LEFT JOIN f_objects o ON e.object_id = o.object_id
WHERE e.repository_id = {REPO} AND e.path = 'd{PATH_USER % 10}/s{PATH_USER % 7}/u{PATH_USER}.dat'""")
def path_history(d: Domain) -> DataFrame:
    return listing.path_history(d.entries, d.snapshots, d.objects, REPO, f"d{PATH_USER % 10}/s{PATH_USER % 7}/u{PATH_USER}.dat")


@query("SELECT e.repository_id, e.snapshot_id, s.created_at, e.path, e.status FROM f_entries e JOIN f_snapshots s ON e.snapshot_id = s.snapshot_id WHERE e.object_id = 13")
def object_references(d: Domain) -> DataFrame:
    return listing.object_references(d.entries, d.snapshots, 13)


@query("SELECT count(*) AS matches, min(object_id) AS object_id, min(digest) AS digest FROM f_objects WHERE starts_with(digest, 'a1')")
def object_hex_prefix(d: Domain) -> DataFrame:
    return listing.by_hex_prefix(d.objects, "a1")


@query("""SELECT cast(c.repository_id AS varchar) AS repository_id, c.path, cast(c.snapshot_id AS varchar) AS snapshot_id, CASE WHEN c.status = 1 THEN 'present' ELSE 'deleted' END AS status,
  cast(c.object_id AS varchar) AS object_id, o.digest, o.size, strftime(c.mtime, '%Y-%m-%dT%H:%M:%SZ') AS mtime
FROM f_entry_cache c LEFT JOIN f_objects o ON c.object_id = o.object_id""")
def api_projection(d: Domain) -> DataFrame:
    return listing.api_rows(d.cache, d.objects)


# ---- differences

DIFF = """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS change, oa.size AS size_before, ob.size AS size_after
FROM a FULL OUTER JOIN b ON a.path = b.path LEFT JOIN f_objects oa ON a.object_id = oa.object_id LEFT JOIN f_objects ob ON b.object_id = ob.object_id
WHERE a.path IS NULL OR b.path IS NULL OR a.object_id <> b.object_id"""
DELTAS = tuple(f"{k} AS (SELECT path, object_id FROM f_entries WHERE snapshot_id = {s} AND status = 1)" for k, s in (("a", LEFT), ("b", RIGHT)))


@query(DIFF, *DELTAS)
def snapshot_diff_delta(d: Domain) -> DataFrame:
    return diff.snapshot_diff(d.entries, d.objects, LEFT, RIGHT, mode="delta", repository_id=REPO)


@query(DIFF, *STATES)
def snapshot_diff_state(d: Domain) -> DataFrame:
    return diff.snapshot_diff(d.entries, d.objects, LEFT, RIGHT, repository_id=REPO)


@query(f"SELECT change, count(*) AS n FROM ({DIFF}) x GROUP BY change", *STATES)
def diff_counts(d: Domain) -> DataFrame:
    return diff.diff_counts(diff.snapshot_diff(d.entries, d.objects, LEFT, RIGHT, repository_id=REPO))


GROUPED = """g AS (SELECT object_id, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE side = 1), '') AS left_paths, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE side = 2), '') AS right_paths
  FROM (SELECT object_id, path, 1 AS side FROM a UNION ALL SELECT object_id, path, 2 AS side FROM b) u GROUP BY object_id)"""


def _texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("left_paths", F.array_join("left_paths", ",")).withColumn("right_paths", F.array_join("right_paths", ","))


@query("SELECT object_id, left_paths, right_paths FROM g", *STATES, GROUPED)
def diff_by_object(d: Domain) -> DataFrame:
    return _texts(diff.by_object(d.entries, LEFT, RIGHT, repository_id=REPO))


@query("""SELECT object_id, left_paths, right_paths, CASE WHEN left_paths = '' THEN 'added' WHEN right_paths = '' THEN 'deleted' WHEN left_paths = right_paths THEN 'same' ELSE 'moved' END AS class FROM g""", *STATES, GROUPED)
def diff_move_classes(d: Domain) -> DataFrame:
    return _texts(diff.move_classes(diff.by_object(d.entries, LEFT, RIGHT, repository_id=REPO)))


@query("SELECT object_id, left_paths, right_paths FROM g",
       *(f"{k} AS (SELECT object_id, path FROM f_entry_cache WHERE repository_id = {r} AND status = 1 AND starts_with(path, 'd'))" for k, r in (("a", 0), ("b", 1))), GROUPED)
def cross_repo_diff(d: Domain) -> DataFrame:
    return _texts(diff.cross_repository(d.cache, 0, 1, left_prefix="d", right_prefix="d"))


# ---- content

@query(f"SELECT r.object_id, o.digest, o.size, r.path, r.encrypted FROM f_replicas r JOIN f_objects o ON r.object_id = o.object_id WHERE r.store_id = {SOURCE}")
def replicas_with_objects(d: Domain) -> DataFrame:
    return content.replicas_in_store(d.replicas, d.objects, SOURCE)


@query("""SELECT r.object_id, s.name, s.url, r.path, r.encrypted FROM f_replicas r JOIN f_stores s ON r.store_id = s.store_id
WHERE r.object_id IN (SELECT object_id FROM f_entry_cache WHERE status = 1)""")
def replicas_with_stores(d: Domain) -> DataFrame:
    return content.replicas_with_stores(d.replicas, d.stores, d.cache.where("status = 1"))


@query("SELECT s.store_id, s.name, count(r.object_id) AS n_replicas FROM f_stores s LEFT JOIN f_replicas r ON s.store_id = r.store_id GROUP BY s.store_id, s.name")
def store_replica_counts(d: Domain) -> DataFrame:
    return content.store_counts(d.replicas, d.stores)


MISSING = f"SELECT object_id FROM f_replicas WHERE store_id = {SOURCE} EXCEPT SELECT object_id FROM f_replicas WHERE store_id = {TARGET}"


@query(f"SELECT object_id, digest, size FROM f_objects WHERE object_id IN ({MISSING})")
def objects_missing_in_dst(d: Domain) -> DataFrame:
    return content.missing_in(d.replicas, d.objects, SOURCE, TARGET)


@query(f"""SELECT path, object_id, CASE WHEN path = min(path) OVER (PARTITION BY object_id) AND object_id NOT IN (SELECT object_id FROM f_replicas WHERE store_id = {TARGET}) THEN 'push' ELSE 'skip' END AS action
FROM f_entry_cache WHERE repository_id = {REPO} AND status = 1""")
def store_push_plan(d: Domain) -> DataFrame:
    return content.push_plan(d.cache, d.replicas, REPO, TARGET)


@query(f"""SELECT r.object_id, r.path AS from_path, o.size, r.encrypted FROM f_replicas r JOIN f_objects o ON r.object_id = o.object_id
WHERE r.store_id = {SOURCE} AND r.object_id IN ({MISSING})""")
def store_copy_plan(d: Domain) -> DataFrame:
    return content.copy_plan(d.replicas, d.objects, SOURCE, TARGET)


@query("""SELECT b.path, b.object_id, coalesce(n.n, 0) AS candidates, n.store, n.replica_path
FROM b LEFT JOIN (SELECT r.object_id, count(*) AS n, arg_min(s.name, s.name) AS store, arg_min(r.path, s.name) AS replica_path
  FROM f_replicas r JOIN f_stores s ON r.store_id = s.store_id WHERE NOT r.encrypted GROUP BY r.object_id) n ON b.object_id = n.object_id WHERE starts_with(b.path, 'd')""", *STATES)
def restore_plan(d: Domain) -> DataFrame:
    return content.restore_plan(state.as_of_in(d.entries, REPO, RIGHT), d.replicas, d.stores, prefix="d")


@query("""SELECT r.object_id, r.store_id, CASE WHEN r.encrypted THEN 'skipped' WHEN r.object_id % 7 = 0 THEN 'missing' WHEN r.object_id % 11 = 0 THEN 'corrupt' ELSE 'ok' END AS result FROM f_replicas r""")
def store_verify(d: Domain) -> DataFrame:
    """Blobs of every seventh object are gone, of every eleventh cut short."""
    blobs = d.replicas.where("object_id % 7 <> 0").join(d.objects, "object_id")
    size = F.col("size") - (F.col("object_id") % 11 == 0).cast("int")
    return content.store_verify(d.replicas, d.objects, blobs.select("store_id", "path", F.col("digest").alias("blob_digest"), size.alias("blob_size")))


@query("""SELECT t.object_id, o.digest, string_agg(concat(t.key, '=', coalesce(t.value, '')), ',' ORDER BY concat(t.key, '=', coalesce(t.value, ''))) AS tags
FROM f_tags t JOIN f_objects o ON t.object_id = o.object_id WHERE t.object_id IN (SELECT object_id FROM f_tags WHERE key = 'quality' AND value = '0') GROUP BY t.object_id, o.digest""")
def tags_search(d: Domain) -> DataFrame:
    return content.tags_search(d.tags, d.objects, "quality", "0").withColumn("tags", F.array_join("tags", ","))


@query("""SELECT object_id, key, value FROM f_tags WHERE NOT (key = 'toxic' AND object_id IN (SELECT object_id FROM f_objects WHERE object_id % 3 = 0))
UNION ALL SELECT object_id, 'toxic' AS key, CASE WHEN object_id % 2 = 0 THEN 'reviewed' END AS value FROM f_objects WHERE object_id % 3 = 0""")
def tags_upsert(d: Domain) -> DataFrame:
    new = d.objects.where("object_id % 3 = 0").select("object_id", F.lit("toxic").alias("key"), F.when(F.col("object_id") % 2 == 0, "reviewed").alias("value"))
    return content.tags_upsert(d.tags, new)


@query("""SELECT c.object_id, c.n_paths, c.low < c.high AS across, c.first_path, o.size, (c.n_paths - 1) * o.size AS wasted
FROM (SELECT object_id, count(*) AS n_paths, min(repository_id) AS low, max(repository_id) AS high, min(path) AS first_path FROM f_entry_cache WHERE status = 1 GROUP BY object_id HAVING count(*) > 1) c
JOIN f_objects o ON c.object_id = o.object_id""")
def dedup_report(d: Domain) -> DataFrame:
    return content.duplicates(d.cache, d.objects)


@query("SELECT object_id, digest, size FROM f_objects WHERE object_id NOT IN (SELECT object_id FROM f_entries WHERE object_id IS NOT NULL)")
def unreferenced_objects(d: Domain) -> DataFrame:
    return content.unreferenced(d.objects, d.entries).select("object_id", "digest", "size")


@query("SELECT max(machine_id) + 1 AS next_id FROM f_machines")
def machine_next_id(d: Domain) -> DataFrame:
    return content.next_id(d.machines)


@query("""SELECT object_id, digest, size FROM f_objects WHERE object_id % 2 = 0
UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY digest) - 1 AS object_id, digest, size FROM f_objects WHERE object_id % 2 = 1""")
def object_get_or_create(d: Domain) -> DataFrame:
    return content.get_or_create(d.objects.where("object_id % 2 = 0"), d.objects, 1_000_000)


# ---- retention

PRUNED = "p AS (SELECT snapshot_id, repository_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM f_snapshots) x WHERE rn > 12 AND created_at < TIMESTAMP '2024-01-16 00:00:00')"


def _pruned(d: Domain) -> DataFrame:
    return retention.prune_set(d.snapshots.drop("parent_id"), keep_last=12, older_than=F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))


@query("SELECT snapshot_id, repository_id, created_at FROM p", PRUNED)
def gc_prune_set(d: Domain) -> DataFrame:
    return _pruned(d)


@query("""SELECT object_id, size FROM f_objects WHERE object_id NOT IN (SELECT object_id FROM f_entries WHERE object_id IS NOT NULL)
  OR (object_id IN (SELECT object_id FROM f_entries WHERE snapshot_id IN (SELECT snapshot_id FROM p) AND object_id IS NOT NULL)
      AND object_id NOT IN (SELECT object_id FROM f_entries WHERE snapshot_id NOT IN (SELECT snapshot_id FROM p) AND object_id IS NOT NULL))""", PRUNED)
def gc_orphans_dry_run(d: Domain) -> DataFrame:
    return retention.orphans_dry_run(d.entries, d.objects, _pruned(d))


#: Roots stand in for tree objects: snapshot s of repository 0 has object s as its root.
LIVE = f"""live AS (SELECT object_id, size FROM f_objects WHERE object_id NOT IN (
  SELECT object_id FROM f_entries WHERE object_id IS NOT NULL AND snapshot_id NOT IN (SELECT snapshot_id FROM p)
  UNION ALL SELECT snapshot_id FROM f_snapshots WHERE repository_id = {REPO} AND snapshot_id NOT IN (SELECT snapshot_id FROM p)))"""


def _live(d: Domain) -> DataFrame:
    roots = d.snapshots.where(F.col("repository_id") == REPO).select("snapshot_id", F.col("snapshot_id").alias("object_id"))
    return retention.orphans_live(d.entries, d.objects, _pruned(d), roots)


@query("SELECT object_id, size FROM live", PRUNED, LIVE)
def gc_orphans_live(d: Domain) -> DataFrame:
    return _live(d)


@query("""SELECT l.object_id, coalesce(r.n, 0) AS n_replicas, coalesce(r.m, 0) AS n_in_scope, coalesce(r.n, 0) = coalesce(r.m, 0) AS removable, l.object_id IN (SELECT object_id FROM f_tags) AS tagged
FROM live l LEFT JOIN (SELECT object_id, count(*) AS n, count(*) FILTER (WHERE store_id IN (0, 1, 2)) AS m FROM f_replicas GROUP BY object_id) r ON l.object_id = r.object_id""", PRUNED, LIVE)
def gc_replica_actions(d: Domain) -> DataFrame:
    return retention.replica_actions(_live(d), d.replicas, d.tags, store_ids=[0, 1, 2])


@query("SELECT repository_id, path, snapshot_id, status FROM f_entry_cache WHERE snapshot_id NOT IN (SELECT snapshot_id FROM p) OR status = 1", PRUNED)
def gc_cache_protected(d: Domain) -> DataFrame:
    return retention.cache_after(d.cache, _pruned(d), protect_live=True).select("repository_id", "path", "snapshot_id", "status")


@query("SELECT snapshot_id, path, status FROM f_entries WHERE snapshot_id NOT IN (SELECT snapshot_id FROM p)", PRUNED)
def gc_entries_after(d: Domain) -> DataFrame:
    return retention.without(d.entries, _pruned(d), "snapshot_id").select("snapshot_id", "path", "status")


# ---- trees

def level_sql(files: str) -> tuple[str, ...]:
    """Digests of three levels of (tree, path, h); h in hex. Children are put in the byte order of their encodings."""
    up = "SELECT tree, parent AS path, {kind} AS kind, sha256(unhex(string_agg(e, '' ORDER BY e))) AS h FROM ({rows}) x GROUP BY tree, parent"
    enc = "concat(CASE WHEN kind = 'F' THEN '46' ELSE '44' END, lower(hex(encode(regexp_extract(path, '[^/]*$')))), '00', h) AS e, regexp_replace(path, '/?[^/]*$', '') AS parent"
    rows = lambda t: f"SELECT tree, {enc} FROM {t}"
    return (
        f"t0 AS (SELECT tree, path, 'F' AS kind, h FROM ({files}) y)",
        "t1 AS (" + up.format(kind="'D'", rows=rows("t0")) + ")",
        "t2 AS (" + up.format(kind="'D'", rows=rows("t1")) + ")",
        "t3 AS (" + up.format(kind="'D'", rows=rows("t2")) + ")",
    )


DOC_FILES = "SELECT 0 AS tree, concat(source, '/', lang, '/', doc_id, '.txt') AS path, sha256(text) AS h FROM documents"


def _doc_files(d: Domain) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.documents.select(F.lit(0).alias("tree"), path.alias("path"), F.unhex("digest").alias("digest"))


def _hex(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.lower(F.hex("digest")))


@query("SELECT path, h AS digest FROM t0", *level_sql(DOC_FILES))
def tree_leaf_digest(d: Domain) -> DataFrame:
    return _hex(_doc_files(d).select("path", "digest"))


@query("SELECT h AS digest, (SELECT count(*) FROM t0) AS n_files, (SELECT count(*) FROM t1) + (SELECT count(*) FROM t2) AS n_dirs FROM t3", *level_sql(DOC_FILES))
def tree_root_native(d: Domain) -> DataFrame:
    return _hex(tree.roots(_doc_files(d), depth=2).select("digest", "n_files", "n_dirs"))


_GIT = "SELECT parent AS path, sha1(unhex(concat(lower(hex(encode(concat('tree ', length(b) // 2)))), '00', b))) AS h FROM (SELECT parent, string_agg(e, '' ORDER BY o) AS b FROM ({rows}) x GROUP BY parent) y"
_GIT_ROWS = "SELECT regexp_replace(path, '/?[^/]*$', '') AS parent, hex(encode(concat(regexp_extract(path, '[^/]*$'), '{slash}'))) AS o, concat(lower(hex(encode(concat('{mode} ', regexp_extract(path, '[^/]*$'))))), '00', h) AS e FROM {t}"


@query("SELECT h AS digest FROM g3",
       "g0 AS (SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS path, sha1(unhex(concat(hex(encode(concat('blob ', octet_length(encode(text))))), '00', hex(encode(text))))) AS h FROM documents)",
       *(f"g{k + 1} AS (" + _GIT.format(rows=_GIT_ROWS.format(slash="/" if k else "", mode="40000" if k else "100644", t=f"g{k}")) + ")" for k in range(3)))
def tree_root_git(d: Domain) -> DataFrame:
    files = d.documents.select(F.lit(0).alias("tree"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), hashing.git_blob(F.encode("text", "utf-8")).alias("digest"))
    return _hex(tree.roots(files, depth=2, digest=tree.git_digest).select("digest"))


STATE_FILES = "SELECT 1 AS tree, a.path, o.digest AS h FROM a JOIN f_objects o ON a.object_id = o.object_id UNION ALL SELECT 2, b.path, o.digest FROM b JOIN f_objects o ON b.object_id = o.object_id"


@query("""SELECT coalesce(x.path, y.path) AS path, coalesce(y.kind, x.kind) AS kind, CASE WHEN x.path IS NULL THEN 'A' WHEN y.path IS NULL THEN 'D' ELSE 'M' END AS change
FROM (SELECT * FROM n WHERE tree = 1) x FULL OUTER JOIN (SELECT * FROM n WHERE tree = 2) y ON x.path = y.path WHERE x.h IS DISTINCT FROM y.h""",
       *STATES, *level_sql(STATE_FILES), "n AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)")
def tree_diff_levels(d: Domain) -> DataFrame:
    part = lambda s, k: state.as_of_in(d.entries, REPO, s).join(d.objects, "object_id").select(F.lit(k).alias("tree"), "path", F.unhex("digest").alias("digest"))
    nodes = materialize(tree.nodes(materialize(part(LEFT, 1).union(part(RIGHT, 2)), "files"), depth=2), "nodes")
    return tree.diff(nodes.where("tree = 1"), nodes.where("tree = 2"), 2)


# ---- exchange

PULL = f"""pull AS (SELECT e.snapshot_id, s.created_at, s.parent_id, e.path, e.status, o.digest, o.size, e.mtime
FROM f_snapshots s JOIN f_entries e ON e.snapshot_id = s.snapshot_id LEFT JOIN f_objects o ON e.object_id = o.object_id
WHERE s.repository_id = {REPO} AND s.created_at > (SELECT created_at FROM f_snapshots WHERE snapshot_id = {RIGHT}))"""


def _pull(d: Domain) -> DataFrame:
    return sync.pull_rows(d.snapshots, d.entries, d.objects, REPO, RIGHT)


@query("SELECT * FROM pull", PULL)
def sync_pull_flat(d: Domain) -> DataFrame:
    return _pull(d)


@query("""SELECT snapshot_id, created_at, parent_id, count(*) AS n_entries, string_agg(concat(path, ':', status, ':', coalesce(substring(digest, 1, 12), '')), ',' ORDER BY path) AS entries
FROM pull GROUP BY snapshot_id, created_at, parent_id""", PULL)
def sync_pull_nested(d: Domain) -> DataFrame:
    text = F.transform("entries", lambda e: F.concat_ws(":", e["path"], e["status"].cast("string"), F.coalesce(F.substring(e["digest"], 1, 12), F.lit(""))))
    return sync.pull_payload(_pull(d)).select("snapshot_id", "created_at", "parent_id", F.size("entries").cast("long").alias("n_entries"), F.array_join(text, ",").alias("entries"))


@query("""SELECT p.digest, r.path, min(s.name) AS store FROM (SELECT DISTINCT digest FROM pull WHERE digest IS NOT NULL) p JOIN f_objects o ON p.digest = o.digest
JOIN f_replicas r ON r.object_id = o.object_id JOIN f_stores s ON s.store_id = r.store_id GROUP BY p.digest, r.path""", PULL)
def sync_pull_replicas(d: Domain) -> DataFrame:
    return sync.pull_replicas(_pull(d), d.objects, d.replicas, d.stores)


@query("SELECT snapshot_id AS source_snapshot_id, repository_id AS source_machine_id, created_at FROM f_snapshots WHERE snapshot_id % 1000 BETWEEN 16 AND 25")
def sync_push_idempotent(d: Domain) -> DataFrame:
    """Days up to 15 were applied before; days 10 to 25 arrive."""
    rows = d.snapshots.select(F.col("snapshot_id").alias("source_snapshot_id"), F.col("repository_id").alias("source_machine_id"), "created_at")
    day = F.col("source_snapshot_id") % 1000
    return sync.new_arrivals(rows.where(day.between(10, 25)), rows.where(day <= 15)).select("source_snapshot_id", "source_machine_id", "created_at")


@query("SELECT repository_id, path, snapshot_id, status, object_id, mtime, depth FROM f_entry_cache")
def sync_merge_cache(d: Domain) -> DataFrame:
    """The cache of day 15 merged with what came later is the cache."""
    early, late = d.entries.where("snapshot_id % 1000 <= 15"), d.entries.where("snapshot_id % 1000 > 15")
    return sync.merge_cache(state.latest(early), late)


@query(f"""SELECT snapshot_id AS source_snapshot_id, created_at, 5000 + row_number() OVER (ORDER BY created_at, snapshot_id) - 1 AS snapshot_id,
  CASE WHEN row_number() OVER (ORDER BY created_at, snapshot_id) = 1 THEN (SELECT max(snapshot_id) FROM f_snapshots WHERE repository_id = 1)
       ELSE 5000 + row_number() OVER (ORDER BY created_at, snapshot_id) - 2 END AS parent_id
FROM f_snapshots WHERE repository_id = {REPO} AND snapshot_id > {RIGHT}""")
def sync_pull_apply(d: Domain) -> DataFrame:
    arriving = d.snapshots.where((F.col("repository_id") == REPO) & (F.col("snapshot_id") > RIGHT)).select(F.col("snapshot_id").alias("source_snapshot_id"), "created_at")
    return sync.apply_pull(d.snapshots.where("repository_id = 1"), arriving, 5000)


@query("SELECT p.repository_id, p.name, greatest(p.last_snapshot_id, m.m) AS last_snapshot_id FROM f_sync_peers p JOIN (SELECT repository_id, max(snapshot_id) AS m FROM f_snapshots GROUP BY repository_id) m ON p.repository_id = m.repository_id")
def sync_peer_progress(d: Domain) -> DataFrame:
    return sync.advance(d.sync_peers, d.snapshots).select("repository_id", "name", "last_snapshot_id")


# ---- scalar functions

@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS got FROM events""")
def json_config_get_set(d: Domain) -> DataFrame:
    return d.table("events").select("event_id", content.json_get(F.col("props"), "k", "none").alias("got"))


@query("""SELECT object_id, CASE WHEN s >= 1000000000 THEN printf('%.1fG', s / 1000000000.0) WHEN s >= 1000000 THEN printf('%.1fM', s / 1000000.0)
  WHEN s >= 1000 THEN printf('%.1fK', s / 1000.0) ELSE concat(s, 'B') END AS shown FROM (SELECT object_id, size * (object_id % 3) * (object_id % 3) * 997 + size AS s FROM f_objects) x""")
def human_size(d: Domain) -> DataFrame:
    k = F.col("object_id") % 3
    return d.objects.select("object_id", paths.human_size(F.col("size") * k * k * 997 + F.col("size")).alias("shown"))


@query("SELECT object_id, CASE WHEN length(h) < 4 THEN concat('objects/', h) ELSE concat('objects/', substring(h, 1, 2), '/', substring(h, 3, 2), '/', h) END AS blob FROM (SELECT object_id, substring(digest, 1, cast(1 + object_id % 64 AS int)) AS h FROM f_objects) x")
def blob_path(d: Domain) -> DataFrame:
    return d.objects.select("object_id", paths.blob_path(F.substring("digest", F.lit(1), (1 + F.col("object_id") % 64).cast("int"))).alias("blob"))


PATHS = "p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)"


@query("""SELECT page_id, length(path) - length(replace(path, '/', '')) AS depth, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
  CASE WHEN trim(path, '/') = '' THEN '' ELSE concat(trim(path, '/'), '/') END AS prefix, lpad(cast(page_id AS varchar), 19, '0') AS padded FROM p""", PATHS)
def path_functions(d: Domain) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    rows = d.table("pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select("page_id", paths.depth(p).alias("depth"), paths.basename(p).alias("name"), paths.parent(p).alias("parent"), paths.as_prefix(p).alias("prefix"), paths.padded_id(F.col("page_id")).alias("padded"))


@query("""SELECT page_id, array_to_string(parts[1:k], '/') AS ancestor FROM (SELECT page_id, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS k FROM p) x""", PATHS)
def path_ancestors(d: Domain) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return d.table("pages").select("page_id", F.explode(paths.ancestors(path)).alias("ancestor"))


# ---- debounce

@query("""SELECT user_id, min(t) AS "first", max(t) AS "last", count(*) AS n_events, least(max(t) + 14400, min(t) + 86400) AS fired_at,
  CASE WHEN min(t) + 86400 < max(t) + 14400 THEN 'max_delay' ELSE 'quiet' END AS reason FROM r GROUP BY user_id, s""",
       "ev AS (SELECT user_id, cast(floor(epoch(ts)) AS bigint) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)",
       """r AS (SELECT * FROM (WITH RECURSIVE q AS (
  SELECT user_id, t, rn, t AS f, 1 AS s FROM ev WHERE rn = 1
  UNION ALL SELECT e.user_id, e.t, e.rn, CASE WHEN e.t - q.t >= 14400 OR e.t - q.f >= 86400 THEN e.t ELSE q.f END, q.s + CASE WHEN e.t - q.t >= 14400 OR e.t - q.f >= 86400 THEN 1 ELSE 0 END
  FROM q JOIN ev e ON e.user_id = q.user_id AND e.rn = q.rn + 1) SELECT * FROM q) z)""")
def debounce_sessions(d: Domain) -> DataFrame:
    """Four hours quiet, a day at most."""
    events = d.table("events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return debounce.sessions(events, key="user_id", time="t", quiet=14_400, max_delay=86_400)


# ---- digests without SQL

@query(None)
def fast_digest_xxh64(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", paths.fast_digest_hex(hashing.xxh64(F.encode("text", "utf-8"))).alias("fast_digest"))


@query(None)
def fast_digest_xxh3(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", paths.fast_digest_hex(hashing.xxh3(F.encode("text", "utf-8"))).alias("fast_digest"))


@query(None)
def digest_blake3(d: Domain) -> DataFrame:
    """Of every document."""
    return d.table("documents").select("doc_id", F.lower(F.hex(hashing.blake3(F.encode("text", "utf-8")))).alias("digest"))


from . import more as _more  # noqa: E402, F401  registers its own queries
from . import deeper as _deeper  # noqa: E402, F401

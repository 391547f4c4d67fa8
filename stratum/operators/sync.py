"""Cloud-safe projection, keyed merges without a table format, and the preset reports."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

from stratum.functions.paths import relative_path, repo_ref, salted_hash, version_key

# Words that no column of a payload may contain.
FORBIDDEN = ("commit_message", "author_email", "absolute_path")
SCHEMA_VERSION = 1


def ensure_safe(schema: DataType) -> None:
    """Raise if a column at any depth of structs, arrays and maps has a forbidden name."""
    while isinstance(schema, ArrayType | MapType):
        schema = schema.elementType if isinstance(schema, ArrayType) else schema.valueType
    if isinstance(schema, StructType):
        for f in schema.fields:
            if any(re.search(w, f.name, re.IGNORECASE) for w in FORBIDDEN):
                raise ValueError(f"forbidden field in payload: {f.name}")
            ensure_safe(f.dataType)


def _keys(json_text: Column) -> Column:
    """Keys of a JSON text at any depth: its strings, one after the other, that a colon follows."""
    strings = F.regexp_extract_all(json_text, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    return F.filter(strings, lambda x: x.endswith(":"))


def forbidden_keys(value: Column, kind: DataType) -> Column:
    """Whether there is a forbidden key in the data: a map's, a VARIANT's, or one of a text that is JSON, at any depth.

    Names of columns and fields are ``ensure_safe``'s.  Texts without any of the words, and without
    an escape that could spell one, aren't parsed; a text that isn't JSON has no keys, a null is safe.
    """
    word = F.lit("(?i)" + "|".join(FORBIDDEN))
    none = F.lit(False)
    if isinstance(kind, StructType):
        found = [forbidden_keys(value[f.name], f.dataType) for f in kind.fields if not _plain(f.dataType)]
        return functools.reduce(operator.or_, found, none)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(value, lambda x: forbidden_keys(x, kind.elementType)), none) if not _plain(kind.elementType) else none
    if isinstance(kind, MapType):
        own = F.coalesce(F.exists(F.map_keys(value), lambda k: F.rlike(k.cast("string"), word)), none)
        return own if _plain(kind.valueType) else own | F.coalesce(F.exists(F.map_values(value), lambda x: forbidden_keys(x, kind.valueType)), none)
    if isinstance(kind, VariantType):
        return F.coalesce(F.exists(_keys(F.to_json(value)), lambda k: F.rlike(k, word)), none)
    if isinstance(kind, StringType):
        parsed = F.to_json(F.try_parse_json(value))
        return F.coalesce((F.rlike(value, word) | F.contains(value, F.lit("\\u"))) & F.exists(_keys(parsed), lambda k: F.rlike(k, word)), none)
    return none


def _plain(kind: DataType) -> bool:
    return not isinstance(kind, StructType | ArrayType | MapType | VariantType | StringType)


def refuse_forbidden(rows: DataFrame) -> DataFrame:
    """The rows, which raise when they are computed if the data of any holds a forbidden key; the schema is looked at now."""
    ensure_safe(rows.schema)
    bad = forbidden_keys(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema)
    return rows.where(F.when(bad, F.raise_error(F.lit("forbidden field in payload")).cast("boolean")).otherwise(True))


def fingerprint(ref: Column, salt: str) -> Column:
    return salted_hash(repo_ref(ref), salt)


def redact_hotspots(spots: DataFrame, salt: str, path: str = "path") -> DataFrame:
    out = spots.select(salted_hash(relative_path(F.col(path)), salt).alias("file_hash"), "touch_count", "last_touched")
    ensure_safe(out.schema)
    return out


def redact_files(files: DataFrame, salt: str, path: str = "path") -> DataFrame:
    return files.select(salted_hash(relative_path(F.col(path)), salt).alias("file_path_hash"), F.lit(None).cast("string").alias("content_hash"))


def redact_directories(dirs: DataFrame, salt: str) -> DataFrame:
    return dirs.select(salted_hash(relative_path(F.col("dir")), salt).alias("dir_hash"), "file_count")


def payloads(repos: DataFrame, tenant: str | Column, user: str, salt: str) -> DataFrame:
    """One row a repository (repo_url, repo_slug, head_commit, structure, hotspots, files, synced_at), redacted."""
    ref = F.when(F.coalesce(F.col("repo_url"), F.lit("")) != "", F.col("repo_url")).otherwise(F.col("repo_slug"))
    mark, tenant = fingerprint(ref, salt), F.lit(tenant) if isinstance(tenant, str) else tenant
    hashed = lambda c, p, *rest: F.transform(c, lambda x: F.struct(salted_hash(relative_path(x[p]), salt).alias("file_hash"), *(x[r].alias(r) for r in rest)))
    out = repos.select(
        tenant.alias("tenant_id"), mark.alias("repo_fingerprint"), mark.alias("canonical_repo_ref_hash"), F.coalesce("head_commit", F.lit("")).alias("head_commit"),
        version_key(tenant, mark, F.coalesce(F.col("head_commit"), F.lit(""))).alias("version_key"),
        hashed("hotspots", "path", "touch_count", "last_touched").alias("hotspot_metrics"),
        F.transform("files", lambda p: F.struct(salted_hash(relative_path(p), salt).alias("file_path_hash"), F.lit(None).cast("string").alias("content_hash"))).alias("file_fingerprints"),
        F.struct(F.lit(user).alias("user_id"), F.col("synced_at"), F.lit(SCHEMA_VERSION).alias("schema_version")).alias("sync_metadata"),
    )
    return refuse_forbidden(out)


def enabled(flag: str | None) -> bool:
    """Whether a switch says so: 1, true, yes or on, in any case, white space aside."""
    return (flag or "").strip().lower() in {"1", "true", "yes", "on"}


#: Tables of the synchronised state with their keys, and the columns that stay as first written.
STATE = {
    "tenants": (("tenant_id",), None),
    "repos": (("tenant_id", "repo_fingerprint"), ()),
    "versions": (("version_key",), ("repo_fingerprint", "head_commit", "first_seen_at")),
    "version_hotspots": (("version_key", "file_hash"), ()),
    "version_files": (("version_key", "file_path_hash"), ()),
}


def payload_rows(sent: DataFrame, run_id: Column | None = None) -> dict[str, DataFrame]:
    """Rows of each table of the state from ``payloads`` rows, one for each key: of several payloads of one key the last counts."""
    meta = F.col("sync_metadata")
    flat = sent.select("*", meta["user_id"].alias("user_id"), meta["synced_at"].alias("synced_at"), meta["schema_version"].alias("schema_version"))
    structure = F.to_json("structure_metrics") if "structure_metrics" in sent.columns else F.lit(None).cast("string")
    spots, files = flat.select("version_key", "synced_at", F.explode("hotspot_metrics").alias("x")), flat.select("version_key", "synced_at", F.explode("file_fingerprints").alias("x"))
    new = {
        "tenants": flat.select("tenant_id", F.col("tenant_id").alias("name"), F.col("synced_at").alias("created_at"), "synced_at"),
        "repos": flat.select("tenant_id", "repo_fingerprint", "canonical_repo_ref_hash", "synced_at"),
        "versions": flat.select("version_key", "repo_fingerprint", "head_commit", structure.alias("structure_json"), "schema_version", F.col("synced_at").alias("first_seen_at"), F.col("synced_at").alias("last_seen_at"), "synced_at"),
        "version_hotspots": spots.select("version_key", F.col("x.file_hash").alias("file_hash"), F.col("x.touch_count").alias("touch_count"), F.col("x.last_touched").alias("last_touched"), "synced_at"),
        "version_files": files.select("version_key", F.col("x.file_path_hash").alias("file_path_hash"), F.col("x.content_hash").alias("content_hash"), "synced_at"),
    }
    out = {}
    for name, rows in new.items():
        key, first = STATE[name]
        columns = [c for c in rows.columns if c != "synced_at"]
        stay = [c for c in columns if c not in key] if first is None else list(first)
        when = F.struct("synced_at", F.struct(*columns))
        rest = [c for c in columns if c not in (*key, *stay)]
        out[name] = rows.groupBy(*key).agg(*(F.min_by(c, when).alias(c) for c in stay), *(F.max_by(c, when).alias(c) for c in rest)).select(*columns)
    runs = flat.select((F.sha2(F.concat_ws(":", "version_key", "synced_at"), 256) if run_id is None else run_id).alias("sync_run_id"), "tenant_id", "user_id", "repo_fingerprint", "head_commit", "version_key", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_summary"), F.col("synced_at").alias("created_at"))
    out["sync_runs"] = runs.dropDuplicates(["sync_run_id"])
    return out


def apply_payloads(state: dict[str, DataFrame], sent: DataFrame, run_id: Column | None = None) -> dict[str, DataFrame]:
    """The state after all ``payloads`` rows of ``sent``, in the order of their synced_at.

    Tenants are only inserted; repositories, versions, hotspots and files are upserted by key, of
    several payloads of one key the last counts; a version keeps when it was first seen; every
    payload adds a run.  ``state`` may lack tables, which then start empty.  ``run_id``: what names
    a run (version key and time, if not given), so a repeated batch gives the same runs.
    """
    out = {}
    for name, once in payload_rows(sent, run_id).items():
        old = state.get(name)
        if name == "sync_runs":
            out[name] = once if old is None else insert_missing(old, once, ["sync_run_id"])
        else:
            key, first = STATE[name]
            out[name] = once if old is None else merge(old, once, key, keep_first=[c for c in once.columns if c not in key] if first is None else first)
    return out


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti"))


def merge(old: DataFrame, new: DataFrame, key: Sequence[str], keep_first: Sequence[str] = (), keep_last: Sequence[str] = ()) -> DataFrame:
    """Upsert: the new row's columns win, but ``keep_first`` stay as they were and ``keep_last`` take the larger.

    One shuffle on the key: old and new are stacked and folded, so neither side is collected.
    """
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    rest = [c for c in old.columns if c not in {*key, *keep_first, *keep_last}]
    out = both.groupBy(*key).agg(
        *(F.min_by(c, "__age").alias(c) for c in keep_first),
        *(F.max(c).alias(c) for c in keep_last),
        *(F.max_by(c, "__age").alias(c) for c in rest),
    )
    return out.select(*old.columns)


def replace_keyed(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entries of ``old`` with a key of ``new`` replaced, the others kept."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def delete_keyed(old: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entries of ``old`` without a key of ``gone``; a null key is a key like others."""
    keys = gone.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct()
    return old.join(keys, functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key)), "left_anti")


def latest(rows: DataFrame, by: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version of each key."""
    order = Window.partitionBy(*by).orderBy(F.desc(version))
    return rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def next_version(rows: DataFrame, by: Sequence[str], version: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, a column of counts for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def preset_versions(versions: DataFrame, repos: DataFrame, limit: int, tenant: str | None = None) -> DataFrame:
    rows = versions.join(repos, "repo_id")
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    return rows.orderBy(F.desc("created_at"), "version_id").limit(limit)


def preset_hotspots(spots: DataFrame, versions: DataFrame, repos: DataFrame, limit: int, tenant: str | None = None) -> DataFrame:
    rows = spots.join(versions, "version_id").join(repos, "repo_id")
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    return rows.orderBy(F.desc("touch_count"), F.desc_nulls_last("last_touched"), "file_hash", "version_id").limit(limit)


def preset_runs(runs: DataFrame, limit: int, tenant: str | None = None) -> DataFrame:
    if tenant is not None:
        runs = runs.where(F.col("tenant_id") == tenant)
    return runs.orderBy(F.desc("created_at"), "run_id").limit(limit)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two manifests by content hash: added, removed or changed."""
    both = old.select("path", F.col("content_hash").alias("was")).join(new.select("path", F.col("content_hash").alias("now")), "path", "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")

"""Role- and account-aware reads: row entitlements, column masks, tags, derived policies.

Spark has no policies of its own here, so they hold at this boundary: :func:`governed` is the only
way the serving functions hand out a table. What isn't entitled is denied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.governance import lineage


@dataclass(frozen=True)
class Principal:
    role: str
    account: str = ""
    user: str = ""


@dataclass(frozen=True)
class Policy:
    """``rows``: (column, entitlements with ``by`` and that column); ``masks``: column to mask."""

    rows: tuple[str, DataFrame] | None = None
    masks: dict[str, Callable[[Column | str, str], Column]] = field(default_factory=dict)
    by: str = "role"


DENY = Policy()


def governed(df: DataFrame, policy: Policy, who: Principal) -> DataFrame:
    """``df`` as ``who`` may see it: entitled rows (a semi-join), masked columns; no row policy, no rows,
    except for the owner."""
    if policy.rows is None:
        df = df if who.role == "owner" else df.limit(0)
    elif who.role != "owner" or policy.by != "role":
        key, rights = policy.rows
        mine = rights.where(F.col(policy.by) == getattr(who, policy.by)).select(F.col(key).alias("__right")).distinct()
        df = df.join(mine, df[key] == mine["__right"], "left_semi")
    return df.withColumns({c: mask(c, who.role) for c, mask in policy.masks.items() if c in df.columns})


#: Which mask a tag stands for.
TAGS: dict[str, Callable[[Column | str, str], Column]] = {"email": fn.mask_email, "phone": fn.mask_phone, "name": fn.mask_name, "coordinate": fn.mask_coordinate}


def tagged(column: Column, name: str, tag: str) -> Column:
    """``column`` as ``name``, with a tag in its metadata, which goes with it through renames and projections."""
    return column.alias(name, metadata={"pii": tag})


def bind_tags(df: DataFrame, who: Principal) -> DataFrame:
    """``df`` with the mask of each tagged column; a tag without a mask shuts its column."""
    out = []
    for f in df.schema.fields:
        tag = (f.metadata or {}).get("pii")
        mask = TAGS.get(tag, lambda c, role: F.lit(None))
        out.append((mask(f.name, who.role) if tag else F.col(f"`{f.name}`")).alias(f.name))
    return df.select(*out)


def cost_by_tag(log: DataFrame, tag: str, units: str) -> DataFrame:
    """Cost by what stands before the first colon of a query's tag, and its share of all."""
    by = log.groupBy(F.split_part(F.col(tag), F.lit(":"), F.lit(1)).alias("part")).agg(F.count(F.lit(1)).alias("queries"), F.sum(units).alias("units"))
    total = by.agg(F.sum("units").alias("__all"))
    return by.crossJoin(F.broadcast(total)).select("part", "queries", "units", F.round(F.lit(100.0) * F.col("units") / F.col("__all"), 2).alias("pct"))


Mask = Callable[[Column | str, str], Column]


def clear(mask: Mask, role: str) -> bool:
    """Whether the mask hands a role the value as it is."""
    return str(mask(F.col("x"), role)) == str(F.col("x"))


def shut(masks: list[Mask]) -> Mask:
    """Null, but for roles that every one of ``masks`` is clear to (with none, for the owner)."""
    return lambda c, role: fn.col(c) if (all(clear(m, role) for m in masks) if masks else role == "owner") else F.lit(None)


class Catalog:
    """Tables with their policies.

    A derived table names its parents. Its columns are followed to theirs through the plan, whatever they are called
    now: one that is a parent's column, or a value chosen from it, keeps that mask; one that is made of masked columns is
    shut to whom any of them is masked, and so is one whose origin can't be told. It has the rows of its parents'
    policies where their key columns are still there, else, without a policy of its own, none.
    """

    def __init__(self) -> None:
        self._tables: dict[str, tuple[DataFrame, Policy, list[Policy]]] = {}
        self._masks: dict[tuple[str, str], Mask] = {}
        self._known: dict[int, tuple[str, str]] = {}
        self.reads: list[tuple[str, str, tuple[str, ...]]] = []
        self._noted: list[tuple[str, str, str]] = []

    def put(self, name: str, df: DataFrame, policy: Policy = DENY, parents: tuple[str, ...] = ()) -> None:
        masks, rows = dict(policy.masks), [policy] if policy.rows or not parents else []
        if parents:
            found = dict(zip(df.columns, lineage.origins(df, self._known), strict=True))
            for c, origin in found.items():
                mask = self._inherited(origin)
                if mask and c not in masks:
                    masks[c] = mask
            for p in parents if not rows else ():
                rows += [self._carried(p, one, found) for one in self._tables[p][2]]
        else:
            # a table that has no parents is what its columns come from
            self._known |= {lineage._id(a): (name, a.name()) for a in lineage._seq(df._jdf.queryExecution().analyzed().output())}
        self._masks |= {(name, c): m for c, m in masks.items()}
        self._tables[name] = (df, Policy(policy.rows, masks, policy.by), rows)

    def _inherited(self, origin: lineage.Origin) -> Mask | None:
        masks = list({id(self._masks[c]): self._masks[c] for c in origin.columns if c in self._masks}.values())
        if lineage.UNKNOWN in origin.columns:
            return shut(masks)
        if not masks:
            return None
        return self._masks[origin.same] if origin.same in self._masks else shut(masks)

    def _carried(self, parent: str, policy: Policy, found: dict[str, lineage.Origin]) -> Policy:
        """A parent's row policy under its key's new name; DENY if the key is no longer there."""
        if policy.rows is None:
            return DENY
        key, rights = policy.rows
        base = {(parent, key)} | {o.same for c, o in self._own(parent).items() if c == key}
        now = next((c for c, o in found.items() if o.same in base), None)
        return DENY if now is None else Policy(rows=(now, rights.withColumnRenamed(key, now)), by=policy.by)

    def _own(self, name: str) -> dict[str, lineage.Origin]:
        df = self._tables[name][0]
        return dict(zip(df.columns, lineage.origins(df, self._known), strict=True))

    def clone(self, name: str, new: str) -> None:
        self._tables[new] = self._tables[name]
        self._masks |= {(new, c): m for c, m in self._tables[name][1].masks.items()}

    def build(self, name: str, reader: str = "") -> DataFrame:
        """The table as it is, its columns marked, for building others from it."""
        df = self._tables[name][0]
        mark = lambda c: {**(df.schema[c].metadata or {}), lineage.MARK: [name, c, *([reader] if reader else [])]}
        return df.select(*[F.col(f"`{c}`").alias(c, metadata=mark(c)) for c in df.columns])

    def read(self, name: str, who: Principal) -> DataFrame:
        df, policy, rows = self._tables[name]
        self.reads.append((who.user or who.role, name, tuple(df.columns)))
        out = self.build(name, who.user or who.role)
        for one in rows:
            out = governed(out, Policy(one.rows, {}, one.by), who)
        return out.withColumns({c: mask(c, who.role) for c, mask in policy.masks.items()}) if policy.masks else out

    def watch(self, spark: SparkSession) -> lineage.ReadListener:
        """While this is entered, each query that runs is noted with the columns it reads of tables from :meth:`read`."""
        return lineage.ReadListener(spark, lambda marks: self._noted.extend((m[2], m[0], m[1]) for m in sorted(marks) if len(m) == 3))

    def column_reads(self, spark: SparkSession) -> DataFrame:
        """Queries by reader, table and column, of those that ran while they were watched."""
        log = spark.createDataFrame(self._noted, "reader string, table_name string, column_name string")
        return log.groupBy("reader", "table_name", "column_name").agg(F.count(F.lit(1)).alias("reads"))

    def lineage(self, spark: SparkSession) -> DataFrame:
        """What was handed out, by reader, table and column, whether or not a query used it."""
        rows = [(who, table, list(columns)) for who, table, columns in self.reads]
        log = spark.createDataFrame(rows, "reader string, table_name string, columns array<string>")
        return log.select("reader", "table_name", F.explode("columns").alias("column_name")).groupBy("reader", "table_name", "column_name").agg(F.count(F.lit(1)).alias("reads"))


PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[0-9][0-9 ()-]{8,14}$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$",
}


def classify(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Proposed categories of string columns: (column, category, share) where enough values match."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, category string, share double")
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*").where("v is not null")
    out = [tall.groupBy("column").agg(F.lit(k).alias("category"), F.avg(F.col("v").rlike(p).cast("double")).alias("share")) for k, p in PATTERNS.items()]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.where(F.col("share") >= share)


def unprotected(found: DataFrame, policy: Policy) -> DataFrame:
    """Proposals of :func:`classify` for columns that the policy has no mask for."""
    return found.where(~F.col("column").isin(list(policy.masks))) if policy.masks else found

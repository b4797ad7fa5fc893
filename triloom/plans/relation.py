"""Solution tables: a column per variable, encoded as late as possible."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms as T


@dataclass(frozen=True)
class Enc:
    """How a column stands for terms.

    term: the term's text. iri: a key, the IRI being prefix + key. literal: a native value of that datatype. text: a struct
    of a text and its language.
    """

    kind: str = "term"
    prefix: str = ""
    datatype: str = ""

    def term(self, c: Column) -> Column:
        if self.kind == "term":
            return c
        if self.kind == "iri":
            return F.concat(F.lit(self.prefix), c.cast("string"))
        if self.kind == "text":
            return F.concat(F.lit('"'), c["lex"], F.lit('"@'), c["lang"])
        if self.datatype == T.DATETIME:
            return T.literal(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), self.datatype)
        return T.literal(c.cast("string"), self.datatype)

    def native(self, c: Column) -> Column:
        """For typed output: values of literals, text of everything else."""
        if self.kind == "literal":
            return c
        return c["lex"] if self.kind == "text" else T.deskolemise(self.term(c)) if self.kind == "term" else self.term(c)

    @property
    def numeric(self) -> bool:
        return self.kind == "literal" and self.datatype in T.NUMERIC

    @property
    def is_literal(self) -> bool:
        return self.kind in ("literal", "text")


TERM = Enc()


def column(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Relation:
    """df has one column per variable of encs; those in maybe can be unbound (null), all others never are."""

    df: DataFrame
    encs: dict[str, Enc]
    maybe: frozenset[str] = frozenset()
    #: Known at compile time to have no rows.
    empty: bool = False

    def term(self, v: str) -> Column:
        return self.encs[v].term(column(v))

    def as_terms(self, names: list[str]) -> Relation:
        todo = [v for v in names if self.encs[v] != TERM]
        if not todo:
            return self
        df = self.df.select(*[self.term(v).alias(v) if v in todo else column(v) for v in self.encs])
        return replace(self, df=df, encs={v: TERM if v in todo else e for v, e in self.encs.items()})

    def select(self, names: list[str]) -> Relation:
        return Relation(self.df.select(*[column(v) for v in names]), {v: self.encs[v] for v in names}, self.maybe & frozenset(names), self.empty)

    def where(self, condition: Column) -> Relation:
        return replace(self, df=self.df.where(condition))


def unit(spark: SparkSession) -> Relation:
    """One solution that binds nothing."""
    return Relation(spark.range(1).select(), {})


def nothing(spark: SparkSession, names: list[str]) -> Relation:
    schema = ", ".join(f"`{v}` string" for v in names)
    df = spark.createDataFrame([], schema) if names else spark.range(0).select()
    return Relation(df, dict.fromkeys(names, TERM), empty=True)


def _aligned(left: Relation, right: Relation, shared: list[str]) -> tuple[Relation, Relation, bool]:
    """Both with equal encodings of the shared variables; False if they can have no common term."""
    todo = []
    for v in shared:
        a, b = left.encs[v], right.encs[v]
        if a == b:
            continue
        if not (left.empty or right.empty or v in left.maybe | right.maybe) and ("iri" in (a.kind, b.kind) and TERM not in (a, b)):
            return left, right, False  # other keys, or an IRI against a literal
        todo.append(v)
    return left.as_terms(todo), right.as_terms(todo), True


def _patterns(names: list[str]) -> list[tuple[bool, ...]]:
    """Which of the names are bound, in every possible way."""
    return list(product((True, False), repeat=len(names)))


def _tagged(side: Relation, open_: list[str], own: list[str], others: list[str]) -> DataFrame:
    """side's rows, once for every null pattern that rows of the other side can have, with what such rows must agree in.

    own and others: those of the open variables that can be unbound here and there. ``#own`` and ``#other`` name the patterns; ``#0`` ... are the
    open variables' values where both sides bind them, else null.
    """
    bound = F.concat(F.lit(""), *[column(v).isNotNull().cast("string").substr(1, 1) for v in own])
    choices = [F.struct(F.lit("".join("ft"[x] for x in p)).alias("name"), *[F.lit(x).alias(f"b{i}") for i, x in enumerate(p)]) for p in _patterns(others)]
    rows = side.df.select("*", bound.alias("#own"), F.explode(F.array(*choices)).alias("#choice"))
    keys = [F.when(F.col(f"`#choice`.b{others.index(v)}"), column(v)).alias(f"#{i}") if v in others else column(v).alias(f"#{i}") for i, v in enumerate(open_)]
    return rows.select(*[column(c) for c in side.df.columns], "`#own`", F.col("`#choice`.name").alias("#other"), *keys)


def _open_pairs(left: Relation, right: Relation, shared: list[str], open_: list[str], how: str) -> DataFrame:
    """Pairs that are compatible where open_, some of the shared variables, can be unbound: one equi-join, for which each side is read once.

    Other columns of left.df stay; ``#hit`` is true for pairs, and of a left row's copies the one with ``#first`` stands for it.
    """
    lefts, rights = [v for v in open_ if v in left.maybe], [v for v in open_ if v in right.maybe]
    a, b = _tagged(left, open_, lefts, rights), _tagged(right, open_, rights, lefts)
    b = b.select(*[column(c).alias(c if c in right.encs and c not in left.encs else f"{c}#right") for c in b.columns])
    on = (column("#own") == column("#other#right")) & (column("#other") == column("#own#right"))
    for v in shared:
        if v not in open_:
            on = on & (column(v) == column(f"{v}#right"))
    for i in range(len(open_)):
        on = on & column(f"#{i}").eqNullSafe(column(f"#{i}#right"))
    new = [v for v in right.encs if v not in left.encs]
    values = [F.coalesce(column(v), column(f"{v}#right")).alias(v) if v in open_ and v in left.maybe else column(v) for v in left.df.columns]
    first = column("#other") == "t" * len(rights)
    return a.join(b, on, how).select(*values, *[column(v) for v in new], column("#own#right").isNotNull().alias("#hit"), first.alias("#first"))


@dataclass(frozen=True)
class Tiles:
    """How a join whose few keys make many pairs is cut: rows of one side are dealt into parts by a hash of the whole row, so
    that any row's retry has the same part; the other side's rows go to every part. tasks: how many share the tiles of all keys."""

    parts: int
    tasks: int
    copy_left: bool

    def join(self, left: DataFrame, right: DataFrame, shared: list[str]) -> DataFrame:
        keys = [*shared, "#part"]

        def laid(df: DataFrame, copied: bool) -> DataFrame:
            whole = F.pmod(F.xxhash64(*[column(v) for v in df.columns]), F.lit(self.parts)).cast("int")
            part = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))) if copied else whole
            return df.select("*", part.alias("#part")).repartition(self.tasks, *[column(v) for v in keys])  # a given number, else they are coalesced by their bytes

        copied, cut = (left, right) if self.copy_left else (right, left)
        return laid(copied, True).hint("merge").join(laid(cut, False), keys)  # a merge join holds its right side's rows of a key: a tile's


def join(left: Relation, right: Relation, tiles: Tiles | None = None) -> Relation:
    """Compatible pairs. Rows that agree by case, as some shared variable can be unbound, meet in one equi-join (_open_pairs()).

    tiles: for joins on variables that are always bound; others go without.
    """
    spark = left.df.sparkSession
    names = list(dict.fromkeys([*left.encs, *right.encs]))
    shared = [v for v in left.encs if v in right.encs]
    left, right, possible = _aligned(left, right, shared)
    if left.empty or right.empty or not possible:
        return nothing(spark, names)
    encs = {v: left.encs[v] if v in left.encs else right.encs[v] for v in names}
    open_ = [v for v in shared if v in left.maybe or v in right.maybe]
    if open_ and len(open_) == len(shared):  # rows that bind no shared variable in common are a product: it goes by itself
        v = open_[0]
        a = Relation(left.df.where(column(v).isNotNull()), left.encs, left.maybe - {v})
        b = Relation(right.df.where(column(v).isNotNull()), right.encs, right.maybe - {v})
        cases = [join(a, b)]
        rest = lambda r: r.select([x for x in r.encs if x != v])
        if v in left.maybe:  # unbound left: the right side's value, bound or not
            cases.append(join(rest(left.where(column(v).isNull())), right))
        if v in right.maybe:  # unbound right, bound left
            cases.append(join(a, rest(right.where(column(v).isNull()))))
        return union(cases)
    maybe = frozenset(v for v in names if v in left.maybe | right.maybe and not (v in shared and (v not in left.maybe or v not in right.maybe)))
    if open_:
        return Relation(_open_pairs(left, right, shared, open_, "inner").select(*[column(v) for v in names]), encs, maybe)
    if not shared:
        return Relation(left.df.crossJoin(right.df).select(*[column(v) for v in names]), encs, maybe)
    pairs = left.df.join(right.df, shared) if tiles is None else tiles.join(left.df, right.df, shared)
    return Relation(pairs.select(*[column(v) for v in names]), encs, maybe)


def _without(left: Relation, right: Relation, condition) -> Relation:
    """The rows of left that no row of right extends; shared variables are bound on both sides."""
    shared, new = [v for v in left.encs if v in right.encs], [v for v in right.encs if v not in left.encs]
    r = right.df.select(*[column(v).alias(f"{v}#right" if v in shared else v) for v in right.encs])
    on = [column(v) == column(f"{v}#right") for v in shared]
    if condition is not None:
        on.append(condition(Relation(left.df, left.encs | {v: right.encs[v] for v in new}, left.maybe | (right.maybe & frozenset(new)))))
    elif not shared:  # any row will do
        r = F.broadcast(r.limit(1).select(F.lit(1).alias("#any")))
    return replace(left, df=left.df.join(r, reduce(lambda x, y: x & y, on, F.lit(True)), "left_anti"))


def left_join(left: Relation, right: Relation, condition=None) -> Relation:
    """left, extended by compatible rows of right where the condition (a function of a Relation, to a Column) holds, else as it is."""
    spark = left.df.sparkSession
    shared = [v for v in left.encs if v in right.encs]
    new = [v for v in right.encs if v not in left.encs]
    if left.empty:
        return nothing(spark, [*left.encs, *new])
    left, right, possible = _aligned(left, right, shared)
    if right.empty or not possible:
        df = left.df.select(*[column(v) for v in left.encs], *[F.lit(None).cast("string").alias(v) for v in new])
        return Relation(df, left.encs | dict.fromkeys(new, TERM), left.maybe | frozenset(new))
    encs, maybe = left.encs | {v: right.encs[v] for v in new}, left.maybe | frozenset(new)
    open_ = [v for v in shared if v in left.maybe or v in right.maybe]
    if open_ and len(open_) < len(shared) and condition is None:
        numbered = replace(left, df=left.df.withColumn("#id", F.monotonically_increasing_id()))
        found = _open_pairs(numbered, right, shared, open_, "left")
        any_ = F.max("`#hit`").over(Window.partitionBy("`#id`"))
        found = found.withColumn("#any", any_).where(column("#hit") | (~column("#any") & column("#first")))
        return Relation(found.select(*[column(v) for v in encs]), encs, maybe)
    split = [v for v in shared if v in left.maybe]
    if split:
        v = split[0]
        bound = Relation(left.df.where(column(v).isNotNull()), left.encs, left.maybe - {v})
        free = left.where(column(v).isNull()).select([x for x in left.encs if x != v])
        return union([left_join(bound, right, condition), left_join(free, right, condition)])
    if open_:  # by case of the right side, then what no case extends
        parts, rest = [], left
        for pattern in _patterns(open_):
            unbound = {v for v, x in zip(open_, pattern, strict=True) if not x}
            own = reduce(lambda r, v: r.where(column(v).isNull() if v in unbound else column(v).isNotNull()), open_, right)
            own = Relation(own.df, own.encs, own.maybe - frozenset(open_)).select([v for v in own.encs if v not in unbound])
            pairs = join(left, own)
            parts.append(pairs if condition is None else pairs.where(condition(pairs)))
            rest = _without(rest, own, condition)
        return union([*parts, rest])
    r = right.df.select(*[column(v).alias(f"{v}#right" if v in shared else v) for v in right.encs])
    on = F.lit(True)
    for v in shared:
        on = on & (column(v) == column(f"{v}#right"))
    if condition is not None:
        on = on & condition(Relation(left.df, encs, left.maybe | (right.maybe & frozenset(new))))
    df = left.df.join(r, on, "left").select(*[column(v) for v in encs])
    return Relation(df, encs, maybe)


def union(parts: list[Relation]) -> Relation:
    """Bag union; a variable that some part lacks is unbound there."""
    spark = parts[0].df.sparkSession
    names = list(dict.fromkeys(v for p in parts for v in p.encs))
    live = [p for p in parts if not p.empty]
    if not live:
        return nothing(spark, names)
    encs = {}
    for v in names:
        found = {p.encs[v] for p in live if v in p.encs}
        encs[v] = found.pop() if len(found) == 1 else TERM
    types = {}
    frames = []
    for p in live:
        p = p.as_terms([v for v in p.encs if encs[v] == TERM])
        types |= {v: p.df.schema[v].dataType for v in p.encs}
        frames.append(p)
    maybe = frozenset(v for v in names if any(v not in p.encs or v in p.maybe for p in live))
    chosen = [p.df.select(*[column(v) if v in p.encs else F.lit(None).cast(types.get(v, "string")).alias(v) for v in names]) for p in frames]
    df = chosen[0]
    for other in chosen[1:]:
        df = df.unionAll(other)
    return Relation(df, encs, maybe)

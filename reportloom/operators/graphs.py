"""Agreement of annotation graphs, within the rows that hold them.

An annotation is a map of entities, each with tokens, a label and relations (type, id of another entity). Entities and relations
become atoms: one text for what an entity or a relation is, whatever its id. Relations find their targets in one sorted array of
the entities and of what is asked of them, and sides are compared as hashed sets. So work grows with the number of entities (their
sort apart), and nothing is exchanged, joined or kept.

Defined results: a null annotation has no atoms, as has an empty one; a null entity counts as one without tokens and label; a
relation of other than two parts, or whose target isn't there, is none; atoms that repeat count once; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import bind, clean_tokens

#: What of an annotation is compared: entities; entities with whether they have relations; entities without relations, and relations; relations.
KINDS = ("entities", "related", "graph", "relations")


def _sized(c: Column) -> Column:
    return F.concat(F.length(c).cast("string"), F.lit(":"), c)


def _entities(ann: Column) -> Column:
    """An annotation as an array of (id, name, relations)."""

    def one(e: Column) -> Column:
        # tokens hold letters and digits only, so these texts are equal where tokens and labels are
        name = F.concat(F.concat_ws(" ", clean_tokens(e.value.tokens)), F.lit("|"), F.trim(F.coalesce(e.value.label, F.lit(""))))
        return F.struct(e.key.alias("id"), name.alias("name"), F.coalesce(e.value.relations, F.array().cast("array<array<string>>")).alias("relations"))

    return F.transform(F.map_entries(ann), one)


def _relations(entities: Column) -> Column:
    """The relations of named entities that find their target, as texts."""

    def asked(e: Column) -> Column:
        begin = lambda r: F.concat(F.lit(">"), _sized(e["name"]), _sized(F.coalesce(r[0], F.lit(""))))
        return F.transform(F.filter(e.relations, lambda r: F.size(r) == 2), lambda r: F.struct(r[1].alias("id"), F.lit(True).alias("asks"), begin(r).alias("text")))

    def found(s: Column) -> Column:
        """Each entity stands before what is asked of its id; other ids' questions may follow, where there is no such entity."""
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).asks)

        def of(at: Column) -> Column:
            def group(p: Column, k: Column) -> Column:
                asks = F.slice(s, p + 2, F.coalesce(F.get(at, k + 1), F.size(s)) - p - 1)
                return bind(F.get(s, p), lambda e: F.transform(F.filter(asks, lambda a: a.id == e.id), lambda a: F.concat(a.text, e.text)))

            return F.flatten(F.transform(at, group))

        return bind(places, of)

    have = F.transform(entities, lambda e: F.struct(e.id.alias("id"), F.lit(False).alias("asks"), e["name"].alias("text")))
    return F.when(F.size(entities) > 0, bind(F.sort_array(F.concat(have, F.flatten(F.transform(entities, asked)))), found))


def atoms(ann: Column, kinds: tuple[str, ...]) -> Column:
    """The distinct atoms of an annotation: a struct with an array for each kind."""
    none = F.array().cast("array<string>")

    def of(x: Column) -> Column:
        e, found = x.e, F.coalesce(x.relations, none)
        related = lambda y: F.size(y.relations) > 0
        made = {
            "entities": lambda: F.transform(e, lambda y: y["name"]), "related": lambda: F.transform(e, lambda y: F.concat(F.when(related(y), "+").otherwise("-"), y["name"])),
            "graph": lambda: F.concat(F.transform(F.filter(e, lambda y: ~related(y)), lambda y: y["name"]), found), "relations": lambda: found,
        }
        return F.struct(*[F.array_distinct(F.coalesce(made[k](), none)).alias(k) for k in kinds])

    targets = {"relations", "graph"} & set(kinds)
    return bind(_entities(ann), lambda e: bind(F.struct(e.alias("e"), (_relations(e) if targets else none).alias("relations")), of))


def counts(ref: Column, hyp: Column, kinds: tuple[str, ...] = ("entities", "relations")) -> Column:
    """A struct with <kind>_ref, <kind>_hyp and <kind>_both for each kind: the atoms of each side and of both."""

    def of(x: Column) -> Column:
        sizes = [(k, {"ref": x.r[k], "hyp": x.h[k], "both": F.array_intersect(x.r[k], x.h[k])}) for k in kinds]
        return F.struct(*[F.size(v).cast("long").alias(f"{k}_{n}") for k, sides in sizes for n, v in sides.items()])

    return bind(F.struct(atoms(ref, kinds).alias("r"), atoms(hyp, kinds).alias("h")), of)


def shares(x: Column, kind: str) -> tuple[Column, Column]:
    """Precision and recall from the counts of a kind; both empty gives 1, hyp empty 0."""
    r, h, both = (x[f"{kind}_{n}"] for n in ("ref", "hyp", "both"))

    def part(of: Column) -> Column:
        return F.when((r == 0) & (h == 0), 1.0).when(h == 0, 0.0).otherwise(both / F.greatest(F.lit(1), of))

    return part(h), part(r)


def agreement(ref: Column, hyp: Column) -> Column:
    """struct(ent_p, ent_r, extra_ent, miss_ent, rel_p, rel_r, extra_rel, miss_rel)."""

    def of(x: Column) -> Column:
        out = []
        for short, kind in (("ent", "entities"), ("rel", "relations")):
            p, r = shares(x, kind)
            both = x[f"{kind}_both"]
            out += [p.alias(f"{short}_p"), r.alias(f"{short}_r"), (x[f"{kind}_hyp"] - both).alias(f"extra_{short}"), (x[f"{kind}_ref"] - both).alias(f"miss_{short}")]
        return F.struct(*out)

    return bind(counts(ref, hyp), of)


def overlap(df: DataFrame, key: str, ref: str = "ref_ann", hyp: str = "hyp_ann") -> DataFrame:
    """Key, ent_p, ent_r, extra_ent, miss_ent, rel_p, rel_r, extra_rel and miss_rel of each row."""
    return df.select(F.col(key).alias("_key"), agreement(F.col(ref), F.col(hyp)).alias("_a")).select(F.col("_key").alias(key), "_a.*")

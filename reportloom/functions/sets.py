"""Set overlap, parsed annotations, label vectors and scores, as Columns; annotations are compared in operators.graphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportloom.functions.text import clean_tokens

ENTITY = "map<string,struct<tokens:array<string>,label:string,relations:array<array<string>>>>"


def overlap(ref: Column, hyp: Column) -> tuple[Column, Column]:
    """Precision and recall of distinct arrays; both empty gives 1, hyp empty 0."""
    both = F.size(F.array_intersect(ref, hyp)).cast("double")
    empty = (F.size(ref) == 0) & (F.size(hyp) == 0)

    def part(of: Column) -> Column:
        return F.when(empty, F.lit(1.0)).when(F.size(hyp) == 0, F.lit(0.0)).otherwise(both / F.greatest(F.lit(1), F.size(of)))

    return part(hyp), part(ref)


def jaccard(a: Column, b: Column) -> Column:
    """Share of two distinct arrays' union that both hold; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.lit(1), union)


def _key(entity: Column) -> Column:
    return F.struct(clean_tokens(entity.tokens).alias("tokens"), F.trim(F.coalesce(entity.label, F.lit(""))).alias("label"))


def entities(annotation: Column) -> Column:
    """M7: the distinct (tokens, label) of an annotation map; null gives none."""
    found = F.array_distinct(F.transform(F.map_values(annotation), _key))
    return F.coalesce(found, F.array().cast("array<struct<tokens:array<string>,label:string>>"))


def relations(annotation: Column) -> Column:
    """M7: the distinct (source, type, target); a relation of other than two parts or with an unknown target is skipped."""

    def of(entity: Column) -> Column:
        good = F.filter(F.coalesce(entity.relations, F.array().cast("array<array<string>>")), lambda r: (F.size(r) == 2) & F.try_element_at(annotation, r[1]).isNotNull())
        return F.transform(good, lambda r: F.struct(_key(entity).alias("source"), r[0].alias("type"), _key(F.try_element_at(annotation, r[1])).alias("target")))

    kind = "struct<tokens:array<string>,label:string>"
    found = F.array_distinct(F.flatten(F.transform(F.map_values(annotation), of)))
    return F.coalesce(found, F.array().cast(f"array<struct<source:{kind},type:string,target:{kind}>>"))


def annotation(json: Column) -> Column:
    """M6: the entity map of an annotation in JSON, through wrappings of up to four levels with one key, or with key 0."""
    now = json
    out = F.lit(None).cast("string")
    for depth in range(5):
        if depth:
            now = F.when(F.size(F.json_object_keys(now)) == 1, F.map_values(F.from_json(now, "map<string,string>"))[0]).otherwise(F.get_json_object(now, "$.0"))
        out = F.coalesce(out, F.get_json_object(now, "$.entities"))
    tokens = F.regexp_replace(out, r'"tokens"\s*:\s*"((?:[^"\\]|\\.)*)"', r'"tokens":["$1"]')
    parsed = F.from_json(tokens, ENTITY)
    return F.transform_values(parsed, lambda _, e: F.struct(F.flatten(F.transform(e.tokens, lambda t: F.split(t, " "))).alias("tokens"), e.label.alias("label"), e.relations.alias("relations")))


def label_agreement(src: Column, cand: Column) -> dict[str, Column]:
    """Counts over two label vectors (1 positive, 0 negative)."""

    def count(test) -> Column:
        return F.aggregate(F.zip_with(src, cand, lambda s, c: F.when(test(s, c), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)

    return {
        "extra_pos": count(lambda s, c: (c == 1) & (s == 0)), "miss_pos": count(lambda s, c: (c == 0) & (s == 1)), "hamming": count(lambda s, c: s != c),
        "src_pos_cnt": count(lambda s, c: s == 1), "cand_pos_cnt": count(lambda s, c: c == 1),
    }


def dot(a: Column, b: Column) -> Column:
    """M3, in the arrays' order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """M3: divided by its length; a zero vector stays."""
    n = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pooled(vectors: Column) -> Column:
    """M4: the mean of normalised vectors, normalised."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, 2, F.greatest(n, F.lit(1))), vectors[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return normalised(F.transform(total, lambda x: x / n))


def class_label(logits: Column, mode: str = "positives") -> Column:
    """M5: the first greatest class; positives: 1 and 3 count as positive, otherwise 1, 0 for 2 and -1 for 3, 0 for none."""
    k = F.array_position(logits, F.array_max(logits)) - 1
    if mode == "positives":
        return F.when(k.isin(1, 3), 1).otherwise(0)
    return F.when(k == 1, 1).when(k == 3, -1).otherwise(0)


def min_max_bytes(pixels: Column, invert: bool = False) -> Column:
    """Pixels scaled to 0..255 and cut to whole numbers; equal pixels give 0 (inverted: 255)."""
    low, high = F.array_min(pixels), F.array_max(pixels)

    def one(x: Column) -> Column:
        u = F.when(high > low, (x.cast("double") - low) / (high - low)).otherwise(F.lit(0.0))
        return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - u if invert else u)) * 255).cast("int")

    return F.transform(pixels, one)


def square_geometry(width: Column, height: Column, side: int = 896) -> dict[str, Column]:
    """Scale, new size and offsets that centre an image in a black square."""
    scale = side / F.greatest(width, height)

    def size(x: Column) -> Column:
        return F.greatest(F.lit(1), F.bround(x * scale).cast("int"))

    w, h = size(width), size(height)
    return {"scale": scale, "new_w": w, "new_h": h, "left": F.floor((side - w) / 2).cast("int"), "top": F.floor((side - h) / 2).cast("int")}


def masked(labels: Column, ids: Column | None = None, first: Column | None = None, value: int = -100) -> Column:
    """V4: labels with the listed ids, or the first so many, replaced."""

    def one(x: Column, i: Column) -> Column:
        hit = F.lit(False)
        if ids is not None:
            hit = hit | F.array_contains(ids, x)
        if first is not None:
            hit = hit | (i < first)
        return F.when(hit, F.lit(value)).otherwise(x)

    return F.transform(labels, one)


def padded(labels: Column, size: Column, side: str = "right", value: int = -100) -> Column:
    """V5: labels lengthened to size."""
    fill = F.array_repeat(F.lit(value), F.greatest(size - F.size(labels), F.lit(0)))
    return F.concat(labels, fill) if side == "right" else F.concat(fill, labels)


def with_prefix(payload: Column, prefix: str) -> Column:
    """M8: the entries of a map whose key begins so."""
    return F.map_filter(payload, lambda k, _: F.startswith(k, F.lit(prefix)))

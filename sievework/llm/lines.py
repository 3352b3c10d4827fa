"""Fuzzy line deduplication by MinHash, in DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.components import connected_components
from sievework.session import free_shuffles, keep_only, made_since, mark, release, written

SHINGLE, LEAST, MINS, ROWS, ROUNDS = 8, 0.8, 20, 4, 3
#: Shingles of a line that are hashed side by side.
RUN = 16
#: Longs of 64 bits in the sketch of a line, a power of two.
WORDS = 16
#: So many pairs are compared at once; of more (and more than half the lines) each component's nearest pair first.
FEW = 20_000
#: Lines of a bucket that one task sorts, about.
BUCKET = 100_000
#: Lines of a crowded bucket that one task compares with the rest of it, about.
PART = 1_000
#: A table of at most so many rows of a few longs (some tens of MB) may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 400_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _norm(line: Column) -> Column:
    """Lower case, with runs of white space as one space and the ends trimmed; most lines need no pattern for it."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\f\x0b":
        odd = odd | F.contains(line, F.lit(c))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def occurrences(docs: DataFrame, id_col: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """One row for each line that holds a shingle: id, th (hash of the text), pos (from 0), norm, h (hash of norm)."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return d.select("id", "th", "pos", _norm(F.col("line")).alias("norm")).where(F.length("norm") >= shingle).withColumn("h", F.xxhash64("norm"))


def _cut(norm: Column | str, shingle: int) -> Column:
    """All character shingles of a line by a lookahead pattern, in one pass; none starts inside a character."""
    return F.regexp_extract_all(norm, F.lit(f"(?s)(?=([^\\x{{DC00}}-\\x{{DFFF}}].{{{shingle - 1}}}))"), F.lit(1))


def _placed(lines: DataFrame, shingle: int, *more: str) -> tuple[DataFrame, str, str]:
    """h, w and u of each line (and more columns), the places of its shingles and the hash of the one at place i, as SQL.

    A shingle is read from the UTF-16 form of the line, where each starts at a known byte (lines with characters
    beyond the base plane: from UTF-32, and then written as UTF-16).
    """
    d = lines.select("h", *more, "norm", F.encode("norm", "UTF-16BE").alias("u")).withColumn("w", F.when(F.octet_length("u") == 2 * F.length("norm"), 2).otherwise(4))
    d = d.select("h", *more, "w", F.when(F.col("w") == 2, F.col("u")).otherwise(F.encode("norm", "UTF-32")).alias("u"))
    part = f"CASE WHEN w = 2 THEN substring(u, i, {2 * shingle}) ELSE encode(decode(substring(u, i, {4 * shingle}), 'UTF-32'), 'UTF-16BE') END"
    return d, f"sequence(1, octet_length(u) - {shingle} * w + 1, w)", f"xxhash64({part})"


def _hashed(texts: DataFrame, cols: dict[str, str], by: list[str], shingle: int = SHINGLE) -> DataFrame:
    """by, and under each name of `cols` the hashes of all shingles of that column's line (repeats included).

    A row of texts is one group of `by`, and rows are dealt by it or a part of it. Lines are cut into runs of RUN
    shingles, whose hashes are made side by side in generated code (a lambda over the places would be interpreted).
    """
    d = texts.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("norm")) for k, c in enumerate(cols.values())])).alias("_l"))
    d, places, _ = _placed(d.select(F.struct(*by).alias("h"), "_l.norm", "_l.side"), shingle, "side")
    d = d.select("h", "side", "w", "u", F.explode(F.expr(places.replace(", w)", f", {RUN} * w)"))).alias("i"))
    d = d.select("h", "side", "w", F.expr(f"substring(u, i, {RUN + shingle - 1} * w)").alias("u"))
    part = "xxhash64(CASE WHEN w = 2 THEN substring(u, {0}, {1}) ELSE encode(decode(substring(u, {2}, {3}), 'UTF-32'), 'UTF-16BE') END)"
    each = ", ".join(part.format(2 * k + 1, 2 * shingle, 4 * k + 1, 4 * shingle) for k in range(RUN))
    d = d.select("h.*", "side", F.expr(f"octet_length(u) DIV w - {shingle - 1}").cast("int").alias("n"), F.expr(f"array({each})").alias("x"))
    d = d.withColumn("x", F.when(F.col("n") < RUN, F.slice("x", 1, F.col("n"))).otherwise(F.col("x")))
    return d.groupBy(*by).agg(*[F.flatten(F.collect_list(F.when(F.col("side") == k, F.col("x")))).alias(c) for k, c in enumerate(cols)])


def sketches(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row for each line: h, size (distinct shingles), w0.. (which of 64 * WORDS bins hold an odd number of them).

    A bin that is odd in one of two lines and even in the other holds a shingle of one of them alone, so the bins that
    differ are at most the shingles that differ: see possible(). texts has one row for each line.
    """
    d = _hashed(texts.select("h", "norm").repartition("h"), {"x": "norm"}, ["h"], shingle)
    d = d.select("h", F.explode(F.array_distinct("x")).alias("x"))
    d = d.select("h", F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(WORDS - 1)).alias("of"), F.expr("shiftleft(1L, CAST(x & 63 AS INT))").alias("bit"))
    return d.groupBy("h").agg(F.count("*").alias("size"), *[F.bit_xor(F.when(F.col("of") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)])


def _sides(c: str) -> list[Column]:
    """The columns of a sketch under names of their own."""
    return [F.col(k).alias(c + k) for k in ("size", *[f"w{i}" for i in range(WORDS)])]


def _differ(u: str, v: str) -> Column:
    """In how many bins two sketches differ."""
    return sum((F.bit_count(F.col(f"{u}w{k}").bitwiseXOR(F.col(f"{v}w{k}"))) for k in range(WORDS)), F.lit(0))


def _far() -> Column:
    return (_differ("u", "v") / F.expr("usize + vsize")).alias("far")


def possible(u: str, v: str, least: float = LEAST) -> Column:
    """Can two sketched lines be alike at all? Never false for a pair whose similarity is at least `least`.

    Of sets a and b with a similarity of s, (1 - s) / (1 + s) * (|a| + |b|) elements are in one alone.
    """
    return _differ(u, v) <= F.lit((1 - least) / (1 + least) + 1e-9) * (F.col(f"{u}size") + F.col(f"{v}size"))


def hopeful(pairs: DataFrame, sketched: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (u, v) that possible() leaves, with usize, vsize and far (the share of bins that differ)."""
    of = lambda c: sketched.select(F.col("h").alias(c), *_sides(c))
    return pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").where(possible("u", "v", least)).select("u", "v", "usize", "vsize", _far())


def signatures(lines: DataFrame, shingle: int = SHINGLE, mins: int = MINS, seed: int = 42) -> DataFrame:
    """One row for each distinct line: h, n (occurrences), m0.. (MinHash values over its character shingles).

    A shingle is hashed once; the hash times an odd constant of each function, plus another, modulo 2^32, is the
    order whose least element that function takes (an exclusive-or would keep elements that share leading bits
    together in every order). Explode and aggregate run in generated code, and map-side combine leaves one row for
    each line to shuffle.
    """
    d, places, x = _placed(lines, shingle)
    d = d.select("h", "w", "u", F.explode(F.expr(places)).alias("i")).select("h", "i", F.expr(f"shiftrightunsigned({x}, 32)").alias("x"))
    rng = random.Random(seed)
    seeds = [(rng.getrandbits(30) | 1, rng.getrandbits(31)) for _ in range(mins)]  # the product stays under 2^63
    return d.groupBy("h").agg(F.sum(F.when(F.col("i") == 1, 1).otherwise(0)).alias("n"), *[F.min((F.col("x") * F.lit(a) + F.lit(b)).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"m{k}") for k, (a, b) in enumerate(seeds)])


def bands(mins: int = MINS, rows: int = ROWS, rounds: int = ROUNDS) -> list[list[int]]:
    """Which MinHash values make up each band: in every round each value is in one band, and with others each time."""
    size = mins // rows
    return [[(b + j * (1 + r)) % size + size * j for j in range(rows)] for r in range(rounds) for b in range(size)]


def _keys(signed: DataFrame, mins: int = MINS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """h and key: one row for each line and band."""
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in band]) for b, band in enumerate(bands(mins, rows, rounds))])
    return signed.select("h", F.explode(keys).alias("key"))


def _ordered_keys(signed: DataFrame, mins: int = MINS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """h, key and order: four values of another band, in whose order similar lines of a bucket lie beside each other."""
    all_ = bands(mins, rows, rounds)
    each = [F.struct(F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in band]).alias("key"), F.array(*[F.col(f"m{k}") for k in all_[(b + 1) % len(all_)][:4]]).alias("order")) for b, band in enumerate(all_)]
    return signed.select("h", F.explode(F.array(*each)).alias("k")).select("h", "k.key", "k.order")


def candidates(signed: DataFrame, mins: int = MINS, rows: int = ROWS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct candidate pairs (u, v), u < v, of lines that share a band, and how often (shared); crowded buckets (key);
    their lines (key, h).

    A bucket of two gives its pair from the aggregate itself. In a larger one every line is paired with the least,
    with the leader, and with the line before it in the order of other MinHash values, so pairs grow with the bucket
    and not with its square. The leader is the line whose buckets are the fullest: that of which the others are
    variants, if they are variants of one. A very large bucket is sorted in several parts. A bucket of over two
    lines may hold pairs beyond these: it is crowded, and across() takes it up. Keys are shuffled before they are
    counted, for hardly any two of a task are alike.
    """
    found = written(_keys(signed, mins, rows, rounds).repartition("key").groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).where("n > 1"), "buckets")
    large = found.where("n > 2").select("key", "lo", "n")
    many = large.count()
    inside = written(_ordered_keys(signed, mins, rows, rounds).join(small(large, many), "key"), "inside")
    crowds, pairs = inside.select("key", "h"), found.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    if many:
        full = inside.groupBy("h").agg(F.sum("n").alias("full"))
        lead = inside.select("key", "h").join(small(full, full.count()), "h").groupBy("key").agg(F.max_by("h", F.struct("full", "h")).alias("lead"))
        inside = inside.join(small(lead, many), "key").withColumn("part", F.pmod(F.xxhash64(F.col("order")[0]), F.ceil(F.col("n") / BUCKET)))
        before = F.lag("h").over(Window.partitionBy("key", "part").orderBy(F.col("order"), "h"))
        inside = inside.withColumn("near", F.array("lo", "lead", before)).select("h", F.explode("near").alias("v")).where("v IS NOT NULL AND v != h")
        pairs = pairs.unionByName(inside.select(F.least("h", "v").alias("u"), F.greatest("h", "v").alias("v")))
    return pairs.groupBy("u", "v").agg(F.count("*").alias("shared")), large.select("key"), crowds


def across(crowds: DataFrame, roots: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST, sketched: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (u, v), u < v, of all lines that share a crowded bucket (key, h) and no component.

    Only pairs go whose numbers of shingles differ by too much to reach `least` or, with the lines' sketches, which
    these show to be unlike. In a bucket the lines beside its largest component meet all of its lines; they are dealt
    out in parts that each meet the whole.
    """
    inside = crowds.join(small(roots, roots.count()), F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("component", "h").alias("root"))
    main = inside.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    split = main.where("main.n < n").select("key", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / PART).alias("parts"))
    split = written(split, "apart")
    sizes = texts.select("h", F.size(F.array_distinct(_cut("norm", shingle))).alias("size")) if sketched is None else sketched
    more = [c for c in sizes.columns if c != "h"]
    inside = written(inside.join(small(split, split.count()), "key").join(sizes, "h"), "split")
    a = inside.where("root != main").select("key", F.pmod(F.xxhash64("h"), "parts").alias("part"), F.col("h").alias("u"), F.col("root").alias("ur"), *[F.col(c).alias(f"u{c}") for c in more])
    b = inside.select("key", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("h").alias("v"), F.col("root").alias("vr"), (F.col("root") == F.col("main")).alias("in_main"), *[F.col(c).alias(f"v{c}") for c in more])
    alike = (F.col("usize") >= F.lit(least) * F.col("vsize")) & (F.col("vsize") >= F.lit(least) * F.col("usize")) if sketched is None else possible("u", "v", least)
    met = a.join(b, ["key", "part"]).where(F.expr("ur != vr AND (in_main OR u < v)") & alike)
    sizes = [] if sketched is None else [F.when(F.expr("u < v"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("usize", "vsize"), ("vsize", "usize"))]
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *sizes, *([] if sketched is None else [_far()])).distinct()


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The pairs (u, v, each once) whose exact Jaccard similarity of character shingles, told apart by a hash of 64
    bits, is at least `least`."""
    of = lambda c: texts.select(F.col("h").alias(c), F.col("norm").alias(f"{c}t"))
    both = pairs.select("u", "v").repartition("u", "v").join(of("u"), "u").join(of("v"), "v")
    both = _hashed(both, {"us": "ut", "vs": "vt"}, ["u", "v"], shingle)
    both = both.select("u", "v", F.size(F.array_union("us", "vs")).alias("n"), F.size(F.array_intersect("us", "vs")).alias("common"))
    return both.where(F.col("common") >= F.lit(least) * F.col("n")).select("u", "v")


def _unjoined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends are not in one component yet, with these (u_root, v_root)."""
    n = roots.count()
    of = lambda c: small(roots.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root")), n)
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.withColumns({f"{c}_root": F.coalesce(f"{c}_root", c) for c in ("u", "v")}).where("u_root != v_root")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after links between components (u_root, v_root): only these are a graph to be searched."""
    began = mark()
    new = written(connected_components(links.select("u_root", "v_root"), "u_root", "v_root"), "merged")
    to = small(new.select(F.col("node").alias("was"), F.col("component").alias("now")), new.count())
    moved = roots.join(to, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    out = written(moved.unionByName(new.join(roots.select("node"), "node", "left_anti")), "roots")
    keep_only(roots.sparkSession, began, out)
    return out


def _linked(pairs: DataFrame, roots: DataFrame, texts: DataFrame, few: int, shingle: int, least: float) -> DataFrame:
    """roots after every pair of hopeful() has been compared or lies inside a component.

    While there are more than `few`, every component's nearest pair is compared first, and what these join is left out.
    """
    spark, done = pairs.sparkSession, False
    pairs = written(_unjoined(pairs, roots), "unjoined")
    while not done:
        n, began = pairs.count(), mark()
        if not n:
            break
        done, turn = n <= few, pairs
        if not done:
            ends = pairs.select(F.explode(F.array("u_root", "v_root")).alias("root"), F.struct("far", "u", "v", "usize", "vsize", "u_root", "v_root").alias("pair"))
            turn = written(ends.groupBy("root").agg(F.min("pair").alias("pair")).select("pair.*").distinct(), "nearest")
            pairs = pairs.join(turn.select("u", "v"), ["u", "v"], "left_anti")
        links = written(verified(turn, texts, shingle, least).join(turn.select("u", "v", "u_root", "v_root"), ["u", "v"]), "verified")
        roots = _merged(roots, links) if links.count() else roots
        if not done:
            pairs = written(_unjoined(pairs.drop("u_root", "v_root"), roots), "unjoined")
        keep_only(spark, began, roots, pairs)
    return roots


def near_components(signed: DataFrame, lines: DataFrame, shingle: int = SHINGLE, least: float = LEAST, spent: list[str] | None = None) -> DataFrame:
    """Components of the lines under the verified pairs of all that share a band: node, component.

    The pairs of candidates() come first, then all others of the crowded buckets whose ends these have not joined, for
    a pair inside a component changes nothing. Pairs that their sketches show to be unlike are not compared by their
    texts. spent: scratch tables that nothing reads once the texts of lines with candidates are stored.
    """
    spark = lines.sparkSession
    pairs, _, crowds = candidates(signed)
    pairs = written(pairs, "pairs")
    free_shuffles(spark)
    named = written(pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct(), "named")
    n = named.count()
    texts = written(lines.select("h", "norm").join(small(named, n), "h", "left_semi").groupBy("h").agg(F.first("norm").alias("norm")), "texts")
    release(spark, spent or [])
    sketched, few = written(sketches(texts, shingle), "sketches"), max(FEW, n // 2)
    roots = written(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0), "roots")
    roots = _linked(written(hopeful(pairs, sketched, least), "hopeful"), roots, texts, few, shingle, least)
    rest = written(across(crowds, roots, texts, shingle, least, sketched), "across")
    free_shuffles(spark)
    return _linked(rest, roots, texts, few, shingle, least)


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The lines to drop: id, th, pos, of every line that is not the first of its component.

    Lines are compared in lower case with white space runs as one space and the ends trimmed. Equal lines, and
    lines that a verified candidate pair joins, are one component; its first line by (id, text hash, position)
    stays, rows without an id last. Lines shorter than a shingle hold none and take no part. Rows alike in id and text are one document.
    """
    spark, began = docs.sparkSession, mark()
    lines = written(occurrences(docs, id_col, text, shingle), "lines")
    spent = made_since(began)
    signed = written(signatures(lines, shingle), "signed")
    where = written(lines.select("h", "id", "th", "pos"), "places")
    free_shuffles(spark)
    node = near_components(signed, lines, shingle, least, spent)
    node = written(node.select(F.col("node").alias("h"), F.col("component").alias("root")), "roots")
    again = written(signed.where("n > 1").select("h").join(node, "h", "full").select("h", F.coalesce("root", "h").alias("root")), "again")
    where = written(where.join(small(again, again.count()), "h").select("root", "id", "th", "pos").distinct(), "where")
    first = where.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos")).alias("first")).select("first.*")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "th", "pos")]
    drop = where.alias("a").join(first.alias("b"), same[0] & same[1] & same[2], "left_anti").select("id", "th", "pos")
    release(spark, made_since(began), but=drop)
    return drop


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with every line dropped that repeats an earlier one, exactly or nearly; columns and rows stay.

    See duplicate_lines() for what counts. The lines that stay keep their order and form; a text that loses all
    its lines becomes empty; null texts stay null; an empty table stays empty. Only the text column changes.
    """
    drop = duplicate_lines(docs, id_col, text, shingle, least)
    drop = written(drop.groupBy("id", "th").agg(F.collect_set("pos").alias("drop")), "drop")  # at most a document's lines
    drop = drop.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("drop").alias("_drop"))
    boxed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    joined = boxed.join(small(drop, drop.count()), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left")
    joined = joined.withColumn("_l", F.when(F.col("_drop").isNotNull(), F.split("_text", "\n", -1)))
    cut = F.expr("array_join(transform(array_except(sequence(0, size(_l) - 1), _drop), i -> _l[i]), '\n')")
    new = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(cut)
    return joined.select(*[new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])

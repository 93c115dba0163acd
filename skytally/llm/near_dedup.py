"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set of word shingles is hashed once; its sketch is the k smallest hashes. Of two sets with Jaccard similarity t,
each of the k smallest hashes of the union lies in both with probability t, so two neighbours in that order lie in both sketches
as neighbours very often. Inverted lists are therefore kept over neighbouring retained values, which few unrelated documents
share. How many neighbours a similar pair shares at least is known (exactly for sets within a sketch, up to ``MISS`` otherwise),
so each document need only be listed under its rarest ones; values that very many documents hold are thus left out unless a
document consists of them.

1. Equal sets are one class, represented by its smallest document.
2. The hub of a list is its class whose keys are the most common ones, in a group of near copies the one the others derive from.
   Each class takes the hub it meets most often as its home, and is compared with it on full sets.
3. Classes of one home that are not yet in its main component are compared, on full sets, with blocks of the home's classes.
4. In lists that still hold several components and homes, classes are compared in blocks across both: those that share enough
   lists and pass the estimate from the union's sketch are verified on full sets.

So no list is expanded into all its pairs, while any two similar classes end in one component. Hashes have 64 bits. Lists over
single values would hold every document that has a common word pair among its retained values; over neighbouring values they hold
nearly none but copies, which is why the retained values are listed by pairs. Large sets are compared in full only where the
estimate from the union of their sketches passes. Tables written on the way are deleted once the components are known.
"""

from __future__ import annotations

from functools import cache
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import blank_null, discard, free_name, materialise
from skytally.llm.components import components

#: Chance at most that a pair at the threshold is missed by the lists, or by the estimate.
MISS = 1e-9
#: Pairs of one set from which on it is copied, and how often.
HOT, SALTS = 512, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of anything but space, tab and line ends."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), "[\\x20\\x09-\\x0D]+"), "")


def shingle_set(words: Column, size: int) -> Column:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words are one shingle, no words none."""
    n = F.size(words)
    if size == 2:
        runs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
    else:
        runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    few = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(words)))
    return F.when(n >= size, F.sort_array(F.array_distinct(runs))).otherwise(few)


@cache
def shared_at_least(k: int, t: float) -> int:
    """c with P(Bin(k, t) < c) <= MISS: retained values that a pair at the threshold shares."""
    tail, c = 0.0, 0
    while (tail := tail + comb(k, c) * t**c * (1 - t) ** (k - c)) <= MISS:
        c += 1
    return c


@cache
def neighbours_at_least(k: int, t: float) -> int:
    """Likewise for neighbouring values that are both shared, among k values in order."""
    last = {(0, True): t, (0, False): 1 - t}
    for _ in range(k - 1):
        new: dict[tuple[int, bool], float] = {}
        for (n, shared), p in last.items():
            for now, q in ((True, t), (False, 1 - t)):
                key = (n + (shared and now), now)
                new[key] = new.get(key, 0.0) + p * q
        last = new
    tail, c = 0.0, 0
    while (tail := tail + last.get((c, True), 0) + last.get((c, False), 0)) <= MISS:
        c += 1
    return max(1, c)


def needed(n: Column, k: int, percent: int) -> Column:
    """How many neighbour keys a set of ``n`` shingles shares at least with any other set similar to it.

    With m values in the union and at most e = (1 - t) m of them unshared, at least m - 2 e - 1 neighbours are shared, m >= n.
    That holds where both sets are within a sketch, so for n <= t k; else the random bound may be less.
    """
    exact = F.ceil((F.lit(2 * percent - 100) * n - 100) / 100).cast("int")
    c = neighbours_at_least(k, percent / 100)
    return F.greatest(F.lit(1), F.when(n * 100 <= k * percent, exact).otherwise(F.least(exact, F.lit(c))))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, k: int) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the whole set (fp, fp2) and its sketch, of which the upper halves of the hashes are kept."""
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(blank_null(F.col(text_col))).alias("w"))
    sets = words.select("doc_id", shingle_set(F.col("w"), size).alias("s"))
    return sets.select(
        "doc_id", F.size("s").cast("long").alias("n_shingles"), F.xxhash64("s").alias("fp"), F.hash("s").alias("fp2"),
        F.transform(F.slice("s", 1, k), lambda x: F.shiftright(x, 32).cast("int")).alias("sketch"),
    )


def listed(classes: DataFrame, k: int, percent: int, least: int = 2) -> DataFrame:
    """node, n, key, least: each class under the rarest of its neighbour keys, so that similar classes meet ``least`` times.

    Keys that one class has alone count as rarest and meet nobody; a class that has enough of them isn't listed at all.
    """
    neighbours = F.zip_with(F.slice("sketch", F.lit(1), F.size("sketch") - 1), F.slice("sketch", F.lit(2), F.size("sketch") - 1), lambda a, b: F.xxhash64(a, b))
    keys = classes.where(F.size("sketch") >= 2).select("node", F.col("n_shingles").alias("n"), F.explode(neighbours).alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    met = keys.join(often, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    total = F.least(F.col("n"), F.lit(k)) - 1
    need = needed(F.col("n"), k, percent)
    some = F.least(F.lit(least), need)
    slots = (total - need + some) - (total - F.size("keys"))
    kept = met.withColumns({"least": some, "slots": slots.cast("int"), "weight": F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + x["df"])}).where("slots > 0")
    return kept.select("node", "n", "least", "weight", F.explode(F.slice("keys.key", F.lit(1), F.col("slots"))).alias("key"))


def compatible(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def passes(shared: Column, of: Column, most: Column, k: int, percent: int) -> Column:
    """Whether an overlap within the union's sketch leaves a pair, the larger set of which has ``most``, a chance; exact for sets within a sketch, but for a value's room for halves that collide."""
    return F.when(most <= k, (shared + 1) * 100 >= of * percent).otherwise(shared >= shared_at_least(k, percent / 100))


def similar(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m with so many shared reach the similarity."""
    return shared * (100 + percent) >= (n + m) * percent


def worth_comparing(a: Column, b: Column, k: int, percent: int) -> Column:
    """Whether the estimate from the union of two sets' sketches leaves them a chance; asked of large sets only, small ones are compared at once.

    Sets are sorted by hash, so a set's first k hashes are its sketch.
    """
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    union = F.slice(F.sort_array(F.array_union(x, y)), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(x, y), union))
    return F.when(F.least(F.size(a), F.size(b)) <= 4 * k, F.lit(True)).otherwise(shared >= shared_at_least(k, percent / 100))


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) with the similarity asked for on full sets, after the estimate from their sketches.

    Where one b stands in more than ``HOT`` pairs, as the hub of a large group does, its set is copied ``SALTS`` times and its pairs
    are dealt over the copies; only such sets are copied.
    """
    side = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"))
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
    hot = pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = pairs.select("a", "b", salt.alias("salt")).join(hot.withColumn("hot", F.lit(True)), ["b", "salt"], "left").join(side("a"), "a")
    dealt = marked.where("hot").join(hot.join(side("b"), "b"), ["b", "salt"])
    both = marked.where("hot IS NULL").join(side("b"), "b").select("a", "b", "sa", "sb").union(dealt.select("a", "b", "sa", "sb")).where(worth_comparing(F.col("sa"), F.col("sb"), k, percent))
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    return shared.where(similar(F.col("i"), F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def within_homes(homes: DataFrame, sets: DataFrame, k: int, percent: int, block: int = 262_144, salts: int = 16) -> DataFrame:
    """Links (a, b) between classes of one home in different components; ``homes`` has node, home and component.

    A home's classes are dealt into blocks of about ``block`` shingles. Each class outside the home's main component goes to every
    block and is compared with the block's classes there, so no pair is a row unless it is a link, and blocks spread over tasks.
    What is known of a home is as small as its components are few, and is joined ``salts`` times over, so that the classes of one
    large home are dealt over as many tasks.
    """
    sized = homes.join(sets.select("node", F.size("s").alias("n")), "node")
    parts = sized.groupBy("home", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    split = (
        parts.groupBy("home").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("n").alias("n"))
        .where("parts > 1").select("home", "main", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    salted = split.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = homes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    rows = dealt.join(salted, ["home", "salt"]).drop("salt").join(sets.select("node", "s"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    blocks = rows.groupBy("home", own.alias("block")).agg(F.collect_list(F.struct("node", "component", "s")).alias("members"))
    asking = rows.where("component <> main").select("home", "main", F.col("node").alias("a"), F.col("component").alias("of"), F.col("s").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def links(y: Column) -> Column:
        n, m = F.size("sa"), F.size(y["s"])
        once = (y["component"] != F.col("of")) & ((y["component"] == F.col("main")) | (y["node"] < F.col("a")))
        return once & compatible(n, m, percent) & worth_comparing(F.col("sa"), y["s"], k, percent) & similar(F.size(F.array_intersect("sa", y["s"])), n, m, percent)

    return asking.join(blocks, ["home", "block"]).select("a", F.explode(F.transform(F.filter("members", links), lambda y: y["node"])).alias("b"))


def across_lists(rest: DataFrame, classes: DataFrame, k: int, percent: int, block: int = 256) -> DataFrame:
    """Pairs (a, b) of different components and homes that meet often enough in the lists ``rest`` and pass the estimate.

    A list's classes are dealt into blocks of about ``block``. Each class goes to its own block and those after it and is compared
    with the classes there, so a pair is a row only when it has passed, in the first list that both are in.
    """
    keys = rest.groupBy("node").agg(F.collect_list("key").alias("keys"))
    lengths = rest.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    rows = rest.join(lengths, "key").join(keys, "node").join(classes.select("node", "sketch"), "node").withColumn("own", own)
    # The bucket is a column of its own, so that the blocks of one list are dealt apart.
    member = F.struct("node", "n", "least", "component", "home", "keys", "sketch")
    blocks = rows.groupBy(F.xxhash64("key", "own").alias("bucket")).agg(F.collect_list(member).alias("members"))
    asking = rows.withColumn("block", F.explode(F.sequence("own", F.col("blocks") - 1))).withColumn("bucket", F.xxhash64("key", "block"))

    def met(y: Column) -> Column:
        both = F.array_intersect("keys", y["keys"])
        once = (y["component"] != F.col("component")) & (y["home"] != F.col("home")) & ((F.col("block") > F.col("own")) | (F.col("node") < y["node"]))
        often = (F.size(both) >= F.least("least", y["least"])) & (F.array_min(both) == F.col("key"))
        union = F.array_union("sketch", y["sketch"])
        # Sketches of sets within k are whole, and so is their union.
        union = F.when(F.greatest("n", y["n"]) <= k, union).otherwise(F.slice(F.sort_array(union), 1, k))
        shared = F.size(F.array_intersect(F.array_intersect("sketch", y["sketch"]), union))
        return once & compatible(F.col("n"), y["n"], percent) & often & passes(shared, F.size(union), F.greatest("n", y["n"]), k, percent)

    return asking.join(blocks, "bucket").select(F.col("node").alias("a"), F.explode(F.transform(F.filter("members", met), lambda y: y["node"])).alias("b"))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = 96
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for every row of ``docs``.

    Two documents are linked where the Jaccard similarity of their shingle sets is ``percent`` / 100 or more; component_id is the
    smallest doc_id that can be reached. Documents without words have no shingles and stand alone. Rows with a null id are never
    linked and are kept, with a null component. Repeated rows belong to the same component. Rows that share an id but not their
    text are placed by their own text. An empty table gives no rows; other columns are ignored.
    """
    slim = materialise(sketches(docs, id_col, text_col, words, k), "sketches")
    full = slim.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialise(full.groupBy("fp", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")), "classes")
    lists = materialise(listed(classes, k, percent), "lists")

    hubs = lists.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    meets = lists.join(hubs, "key").groupBy("node", "hub").agg(F.count("*").alias("times"))
    other = F.struct((F.col("hub") != F.col("node")).cast("int"), "times", -F.col("hub"))
    nearest = meets.groupBy("node").agg(F.max_by("hub", other).alias("near"), F.max_by("hub", F.struct("times", -F.col("hub"))).alias("home"))
    nearest = materialise(nearest, "homes")

    texts = docs.select(F.col(id_col).cast("long").alias("node"), blank_null(F.col(text_col)).alias("t"))
    listed_words = texts.join(nearest.select("node").hint("shuffle_hash"), "node", "left_semi").select("node", words_of(F.col("t")).alias("w"))
    sets = materialise(listed_words.select("node", shingle_set(F.col("w"), words).alias("s")), "sets")

    stars = materialise(verified(nearest.where("near <> node").select(F.col("node").alias("a"), F.col("near").alias("b")), sets, k, percent), "links")
    found = components(stars)
    label = lambda df: df.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Homes whose hubs are linked are one.
    hub_of = found.select(F.col("node").alias("home"), F.col("component").alias("hub"))
    homes = materialise(nearest.select("node", "home").join(hub_of, "home", "left").select("node", F.coalesce("hub", "home").alias("home")), "homes")
    inner = materialise(within_homes(label(homes), sets, k, percent), "links")
    first, found = found, components(stars.union(inner))

    labelled = label(lists.drop("weight").join(homes, "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("home").alias("lh"), F.max("home").alias("hh"))
    rest = materialise(labelled.join(mixed.where("lo < hi AND lh < hh").select("key"), "key", "left_semi"), "rest")
    more = materialise(across_lists(rest, classes, k, percent), "pairs")
    late = verified(more, sets, k, percent)
    stars_found = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(stars_found.union(late))
    discard(lists, nearest, sets, stars, homes, inner, rest, more, first, found)

    of_class = classes.join(final, "node", "left").select("fp", "fp2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = slim.drop("sketch").join(of_class, ["fp", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for.

    Documents without words and rows with a null id stay; rows that share an id go together, once any of them is a copy of a
    document with a smaller id; an empty table stays empty; all columns, whatever their names, stay as they are.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, percent=percent)
    key = free_name("gone_id", docs)
    gone = found.where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col].cast("long") == gone[key], "left_anti")

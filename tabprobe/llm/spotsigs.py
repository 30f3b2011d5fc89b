"""Document fingerprints by SpotSigs, with DataFrame functions only.

Signatures start at common words: an anchor with the chain of the next content words after it. Running text is full of
them, while menus, lists and numbers have few, and are known by their words as well. A fingerprint is the set of a document's signatures, and the likeness of two is the Jaccard
similarity of the sets. A join deals fingerprints by set length: sets that reach a similarity t have lengths within a
factor t, so each meets its own length class and the next longer one, there only by a rare signature that stands at the front of both. Its result
is pairs between representatives, and for every row the one that stands for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import cut, named, small, whole_text

#: Function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were will with "
    "aber als am auch auf aus bei das dem den der des die du ein eine einer es für hat ich im ist mit nicht sich sie sind und von war wie zu zum "
    "au aux avec ce ces dans de elle en est et il je la le les leur mais ne nous ou par pas plus pour que qui sa se ses son sur un une vous "
    "al como con del el ella era fue las lo los más no o para pero por sin su sus te una y ya"
).split()
#: Letters, digits and combining marks make words.
OTHER = r"[^\p{L}\p{M}\p{N}]+"
#: Hexadecimal digits of a signature's hash.
DIGITS = 16
#: Texts of fewer distinct chains have words as signatures, too.
FEW = 64
#: Documents to a stretch of the order by id, about, and quantiles by which ids are dealt to stretches.
STRETCH, QUANTILES = 4096, 64


def tree_pattern(words: list[str]) -> str:
    """A pattern for the words that branches letter by letter."""
    branches: dict[str, list[str]] = {}
    for word in words:
        branches.setdefault(word[:1], []).append(word[1:])
    parts = [first + (tree_pattern(rest) if rest != [""] else "") for first, rest in branches.items() if first]
    inner = parts[0] if len(parts) == 1 and "" not in branches else f"(?:{'|'.join(parts)})"
    return f"(?:{inner})?" if "" in branches and parts else inner


def plain_words(text: Column) -> Column:
    """Lower-cased words between single blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), OTHER, " ")), F.lit(" "))


def chains(text: Column, anchors: list[str] = ANCHORS) -> Column:
    """Every "anchor content content" of a text.

    Of several anchors in a row only the last counts; its chain is the next two content words, whatever anchors stand between them.
    """
    anchor = tree_pattern(list(dict.fromkeys(anchors)))
    single = F.regexp_replace(plain_words(text), f"(?<= ){anchor} (?={anchor} )", "")
    content = rf"(?!{anchor} )[^ ]++"
    chained = F.regexp_replace(single, f"(?<= )({anchor})(?= ({content})(?: {anchor})? ({content}) )", "\n$1 $2 $3\r")
    return F.regexp_extract_all(chained, F.lit("\n([^\r]*)\r"), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value for several uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_signatures(df: DataFrame, text_col: str, out: str, anchors: list[str] = ANCHORS) -> DataFrame:
    """Add a text's sorted distinct signatures, as hash prefixes in hexadecimal.

    Texts of few chains have content words as signatures as well, the more the fewer chains they have: with c distinct chains, those words whose hash lies in
    the first ``FEW`` - c of ``FEW`` equal parts, so with none all of them, and with ``FEW`` or more none. Two texts that differ by a chain
    or two thus share nearly all words that they have in common, and no number of chains turns one kind of fingerprint into another. Without
    content words all words stand for them, and without words the text itself; an empty text has none. Chains are a column of their
    own, as a plan would else find them anew wherever they are named.
    """
    text, plain = F.col(text_col), plain_words(F.col(text_col))
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    content = F.filter(words, lambda w: ~w.isin(list(anchors)))
    some = let(content, lambda c: F.when(F.size(c) > 0, c).otherwise(words))
    # the first two digits of a word's hash tell its part
    kept = F.filter(some, lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") * FEW < 256 * (FEW - F.col("_few")))
    found = (
        F.when(F.col("_few") >= FEW, F.col("_chains")).when(text == "", F.array().cast("array<string>"))
        .when(F.trim(plain) != "", F.concat("_chains", kept)).otherwise(F.array(text))
    )
    hashed = F.array_sort(F.array_distinct(F.transform(found, lambda s: F.substring(F.md5(s), 1, DIGITS))))
    few = F.least(F.size("_chains"), F.lit(FEW))
    return df.withColumn("_chains", F.array_distinct(chains(text, anchors))).withColumn("_few", few).withColumn(out, hashed).drop("_chains", "_few")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def stretches(rows: DataFrame) -> Column:
    """A column that deals the whole-number ``key`` to stretches of its order, about as many rows to each.

    Quantiles of the keys split the order, however the ids lie, and equal ranges split what lies between two quantiles.
    """
    keys, key = rows.select("key"), F.col("key")
    n = keys.count()
    bounds = sorted(set(int(b) for b in keys.approxQuantile("key", [i / QUANTILES for i in range(QUANTILES + 1)], 0.001))) if n else []
    if len(bounds) < 2:
        return F.lit(0).cast("long")
    parts = math.ceil(n / (STRETCH * (len(bounds) - 1)))
    literal = F.array(*[F.lit(b) for b in bounds])
    place = F.greatest(F.least(F.size(F.filter(literal, lambda b: b <= key)), F.lit(len(bounds) - 1)), F.lit(1))
    low, high = F.element_at(literal, place), F.element_at(literal, place + 1)
    inside = F.least(F.greatest(F.floor((key.cast("double") - low) / (high.cast("double") - low) * parts), F.lit(0)), F.lit(parts - 1))
    return ((place - 1) * parts + inside).cast("long")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, stretch, far, key, mark, ghost): rows dealt so that in each stretch, in the order of (far, key descending, mark), a row's
    successor is the next document by descending id; after the last comes the first.

    The row after a stretch's last is its ghost there, copied from the head of the next stretch. Heads are few: one id per stretch.
    """
    rows = df.select(named(id_col).alias("id"), whole_text(named(text_col)).alias("text"), F.coalesce(named(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"))
    rows = rows.withColumn("stretch", stretches(rows))
    heads = cut(rows.select("stretch", "key").groupBy("stretch").agg(F.max("key").alias("head")))
    n = heads.count()
    order = Window.orderBy("stretch")  # one row per stretch
    ghosts = heads.select(
        F.col("head").alias("g_key"), F.coalesce(F.lead("stretch").over(order), F.first("stretch").over(order)).alias("g_stretch"),
        F.lead("stretch").over(order).isNull().alias("g_far"),
    )
    here = F.struct(F.col("stretch").alias("stretch"), F.lit(False).alias("far"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("g_stretch").alias("stretch"), F.col("g_far").alias("far"), F.lit(True).alias("ghost"))
    joined = rows.join(small(ghosts, n), F.col("key") == F.col("g_key"), "left")
    places = F.explode(F.when(F.col("g_key").isNull(), F.array(here)).otherwise(F.array(here, there)))
    return joined.withColumn("place", places).select("id", "text", "key", F.xxhash64("text").alias("mark"), "place.stretch", "place.far", "place.ghost")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, anchors: list[str] = ANCHORS) -> DataFrame:
    """(id, text, signatures) of every row. Null texts count as empty; repeated rows stay, an empty table gives none, and equal texts have equal signatures."""
    return df.select(named(id_col).alias("id"), whole_text(named(text_col)).alias("text")).transform(with_signatures, "text", "signatures", anchors)


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, anchors: list[str] = ANCHORS) -> DataFrame:
    """Fingerprints of texts, of edited texts and of the next document's, and their likeness.

    In the edited text, the last third of the code points (rounded down) is replaced by as many of the first of the next document, or all of them if it
    is shorter. The next document is the one with the next smaller id; after the smallest comes the largest. Rows that share an id follow
    each other, by a hash of the text; null ids come last. An empty table gives none. One document alone is its own next. One exchange of the texts.
    """
    rows = with_next(df, id_col, text_col)
    order = Window.partitionBy("stretch").orderBy("far", F.col("key").desc(), "mark")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    seen = with_signatures(rows.withColumn("next_text", F.lead("text").over(order)), "text", "signatures", anchors)
    seen = seen.withColumn("next_signatures", F.lead("signatures").over(order)).where("NOT ghost")
    seen = seen.withColumn("edited", F.concat(F.substring("text", 1, n - third), F.substring("next_text", F.lit(1), third)))
    seen = with_signatures(seen, "edited", "edited_signatures", anchors)
    return seen.select(
        "id", n.cast("long").alias("n_chars"), "edited", "signatures", "edited_signatures",
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def print_classes(prints: DataFrame) -> DataFrame:
    """(class, id, signatures): every different fingerprint of ``prints`` (id, signatures) once, with the smallest id that carries it.

    Empty fingerprints and null ids make no class. ``class`` is a number of its own: rows may share an id and still differ.
    """
    known = prints.where((F.size("signatures") > 0) & F.col("id").isNotNull())
    return cut(known.groupBy("signatures").agg(F.min("id").alias("id")).select(F.monotonically_increasing_id().alias("class"), "id", "signatures"))


def rare_first(classes: DataFrame) -> DataFrame:
    """(class, id, n, ranked): signatures in the order of how many classes have them, so that what is common stands at the end."""
    every = classes.select("class", F.explode("signatures").alias("s"))
    common = every.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    ranked = every.join(common, "s").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("r"))
    return classes.select("class", "id", F.size("signatures").alias("n")).join(ranked, "class").select("class", "id", "n", F.col("r.s").alias("ranked"))


def similar_classes(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, class_a, class_b, likeness) of classes that reach the threshold; a and b are their ids, a the one of fewer signatures, or the smaller id.

    Classes are dealt by level, the length's logarithm to the base 1 / threshold: what reaches the threshold lies in one level or in two that follow each other.
    Within a level, two sets meet only by a signature among the first of both, rare ones first; the places where they meet tell how many more can follow.
    """
    placed = cut(rare_first(classes).withColumn("level", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9).cast("int")))
    front = F.slice("ranked", 1, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    keyed = placed.select("class", "id", "n", "level", F.posexplode(front).alias("place", "key"))
    longer = keyed.select(F.col("class").alias("class_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), "key", "level")
    shorter = keyed.select(
        F.col("class").alias("class_a"), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), "key",
        F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"),
    )

    def order_of(x: str) -> Column:
        return F.struct(F.col(f"n_{x}").alias("n"), F.col(x).alias("id"), F.col(f"class_{x}").alias("class"))

    needed = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    pruned = (
        shorter.join(longer, ["key", "level"])
        .where(order_of("a") < order_of("b"))
        .where(F.col("n_a") >= F.col("n_b") * threshold - 1e-9)
        # no later meeting can make up for what went before the first one
        .where(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= needed)
        .select("a", "b", "class_a", "class_b").distinct()
    )
    first, second = (classes.select(F.col("class").alias(f"class_{x}"), F.col("signatures").alias(f"s{x}")) for x in "ab")
    found = pruned.join(first, "class_a").join(second, "class_b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return found.where(F.col("likeness") >= threshold - 1e-12).select("a", "b", "class_a", "class_b", "likeness")


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints that reach the threshold; a and b are the smallest ids that carry them.

    ``prints`` has (id, signatures). Equal fingerprints are one, so copies make no pairs: ``near_counts`` says which id stands for a row. Empty ones make none.
    """
    return similar_classes(print_classes(prints), threshold).select("a", "b", "likeness")


def near_counts(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, n_equal, n_near) of every row of ``prints`` (id, signatures).

    ``class_id`` is the smallest id with an equal fingerprint, ``n_equal`` the rows that have it, itself included, and ``n_near`` the rows with another one
    that reaches the threshold. Empty fingerprints and null ids have a null class, no equals and none near.
    """
    classes = print_classes(prints)
    pairs = cut(similar_classes(classes, threshold).select("class_a", "class_b"))
    sizes = prints.where(F.col("id").isNotNull()).groupBy("signatures").agg(F.count(F.lit(1)).alias("n_equal"))
    sized = cut(classes.join(sizes, "signatures").select("class", "n_equal"))
    both = pairs.union(pairs.select("class_b", "class_a")).toDF("class", "other")
    near = both.join(sized.toDF("other", "n_other"), "other").groupBy("class").agg(F.sum("n_other").alias("n_near"))
    known = classes.join(sized, "class").join(near, "class", "left").select("signatures", F.col("id").alias("class_id"), "n_equal", F.coalesce("n_near", F.lit(0)).alias("n_near"))
    rows = prints.select("id", "signatures")
    told = rows.where(F.col("id").isNotNull()).join(known, "signatures", "left")
    bare = rows.where(F.col("id").isNull()).withColumns({"class_id": F.lit(None).cast(rows.schema["id"].dataType), "n_equal": F.lit(None).cast("long"), "n_near": F.lit(None).cast("long")})
    every = told.select("id", "class_id", "n_equal", "n_near").unionByName(bare.select("id", "class_id", "n_equal", "n_near"))
    return every.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_equal", "n_near")})

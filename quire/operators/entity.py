"""Works, titles, authors and names: grouping renderings of one thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx


def duplicate_clusters(df: DataFrame, id_: str, title: str, author: str) -> DataFrame:
    """Clusters of works with one title key and one author (AGG11): title_key, author_key, ids, n.

    A row without an author joins a cluster only where its title has exactly one real author.
    """
    k = df.select(F.col(id_).alias("id"), tx.title_key(title).alias("title_key"), tx.author_key(F.coalesce(F.col(author), F.lit(""))).alias("author_key"))
    known = k.where("author_key <> ''").groupBy("title_key").agg(F.countDistinct("author_key").alias("authors"), F.min("author_key").alias("only"))
    j = k.join(known, "title_key", "left")
    joined = F.when((F.col("author_key") == "") & (F.col("authors") == 1), F.col("only")).otherwise(F.col("author_key"))
    c = j.withColumn("author_key", joined).groupBy("title_key", "author_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return c.where("n >= 2 and title_key <> ''")


def shared_word_pairs(titles: DataFrame, id_: str, title: str, least: int = 2, longer_than: int = 3, most: int = 200) -> DataFrame:
    """Pairs of distinct titles that share at least ``least`` words of more than three letters (JOI7).

    Titles meet through equal words, never all against all.  A word that over
    ``most`` titles share is not used to bring two together; a pair whose only
    shared words are such words is found through pairs of them.
    """
    w = titles.select(F.col(id_).alias("id"), F.explode(F.array_distinct(F.split(tx.normalize_title(title), " "))).alias("w")).where(F.length("w") > longer_than)
    common = w.groupBy("w").count().where(F.col("count") > most).select("w", F.lit(True).alias("common"))
    tagged = w.join(common, "w", "left")
    rare = tagged.where("common is null").select("id", "w")
    both = tagged.where("common").groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    twos = both.select("id", F.explode(F.flatten(F.transform("ws", lambda a: F.transform(F.filter("ws", lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b))))).alias("w"))
    near = rare.alias("a").join(rare.alias("b"), "w").where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    near = near.unionByName(twos.alias("a").join(twos.alias("b"), "w").where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))).distinct()
    words = w.groupBy("id").agg(F.collect_set("w").alias("ws"))
    j = near.join(words.select(F.col("id").alias("a"), F.col("ws").alias("x")), "a").join(words.select(F.col("id").alias("b"), F.col("ws").alias("y")), "b")
    return j.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared")).where(F.col("shared") >= least)


def edition_key(df: DataFrame) -> DataFrame:
    """``df`` with ``edition_key``: edition, else album, else folder, else origin, else the id (AGG10)."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.withColumn("edition_key", F.coalesce(some("edition"), some("album"), some("folder"), some("origin"), F.col("id").cast("string")))


#: Titles before a name.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "m", "mme", "mlle", "prof", "professor", "capt", "col", "rev")
PLACE_FACTOR, NAME_FACTOR = 0.02, 1.4


def name_tokens(df: DataFrame, work: str, doc: str, text: str = "text") -> DataFrame:
    """Words of texts with what tells a name (AGG24): low, surface, title (capitalised), shout (all capitals), inner (not at the start of a sentence), the title in front, and behind a capitalised word the next one if that is one too.

    Each document is looked at by itself, so no word has a neighbour in another
    one, and in its own row, so no word is dealt to find its neighbours.
    """
    mark = lambda x: F.left(x, F.lit(1)).isin(".", "!", "?")
    lower = lambda x: F.when(F.endswith(F.lower(x), F.lit("'s")), F.left(F.lower(x), F.length(F.lower(x)) - 2)).otherwise(F.lower(x))
    honorific = lambda x: lower(x).isin(*HONORIFICS)
    capital = lambda x: x.rlike(r"^\p{Lu}")
    shout = lambda x: x.rlike(r"^\p{Lu}[\p{Lu}'\-]+$")
    t = df.select(work, doc, F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}'\-]*|[.!?]+"), 0).alias("all"))
    # A single dot after a title is no end of a sentence; it falls away before neighbours are looked at.
    t = t.select(work, doc, F.filter("all", lambda x, i: (x != ".") | ~F.coalesce(honorific(F.get("all", i - 1)), F.lit(False))).alias("kept"))
    beside = F.transform("kept", lambda x, i: F.struct(x.alias("tok"), F.get("kept", i - 1).alias("prev"), F.get("kept", i + 1).alias("next_tok")))
    t = t.select(work, doc, F.posexplode(beside).alias("pos", "x")).select(work, doc, "pos", "x.tok", "x.prev", "x.next_tok").where(~mark(F.col("tok")))
    tok, prev, after = F.col("tok"), F.col("prev"), F.col("next_tok")
    t = t.withColumn("low", lower(tok)).withColumn("shout", capital(tok) & shout(tok)).withColumn("title", capital(tok) & ~shout(tok))
    t = t.withColumn("inner", ~F.coalesce(mark(prev), F.lit(True))).withColumn("prefix", F.when(honorific(prev), prev))
    return t.withColumn("next_low", F.when(F.col("title") & capital(after) & ~shout(after), lower(after))).drop("prev")


def place(df: DataFrame, doc: str) -> Column:
    """Documents and places in them in one value that can be ordered: a number where documents have whole numbers, so that the least of a group is found by hash."""
    if dict(df.dtypes)[doc] not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct(doc, "pos")
    # A document without a number comes first.
    return F.coalesce(F.col(doc).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")


def cast_names(df: DataFrame, work: str, doc: str, text: str = "text", least: int = 3, most: int = 30, noise: tuple[str, ...] = (), places: tuple[str, ...] = ()) -> DataFrame:
    """Names of each work's cast (AGG25): work, name, mentions, total, in_dictionary, place, score, rank.

    A pair of neighbouring names becomes one where it makes up at least half of
    both; words mostly in capitals are headings.  Words that the texts also
    write in lower case at least as often as within sentences in upper case
    count as dictionary words; the others weigh more, and places very little.

    Words are counted once, where they lie; what can be a name, or part of one,
    has ``least`` capitalised places, and only such words go on.
    """
    t = name_tokens(df, work, doc, text)
    unwanted = lambda c: F.col(c).isin(*HONORIFICS, *noise)
    shown = F.when(F.col("title"), F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit(". "), "tok")).otherwise(F.col("tok")))
    n = t.groupBy(work, "low", shown.alias("name")).agg(F.count_if(F.col("title") & F.col("inner")).alias("mid"), F.count_if("title").alias("caps"), F.count("*").alias("total"), F.count_if("shout").alias("shouts"), F.min(F.when(F.col("title"), place(t, doc))).alias("at"))
    name = F.min(F.when(F.col("name").isNotNull(), F.struct("at", "name")))["name"].alias("name")
    n = n.groupBy(work, "low").agg(*[F.sum(c).alias(c) for c in ("mid", "caps", "total", "shouts")], name).where(F.col("caps") >= least)

    two = t.where(F.col("title") & F.col("next_low").isNotNull() & ~unwanted("low") & ~unwanted("next_low"))
    first = F.min(F.struct(F.col(doc).alias("d"), "pos", F.concat_ws(" ", "tok", "next_tok").alias("name")))
    two = two.groupBy(work, "low", "next_low").agg(F.count("*").alias("both"), first["name"].alias("pair")).where(F.col("both") >= least)
    # Either word of a pair meets its counts; a pair is one name where both words say so, and a word of such a pair is none by itself.
    sides = two.select(work, F.col("low").alias("a"), F.col("next_low").alias("b"), "both", "pair", F.explode(F.array(F.struct("low", F.lit(0).alias("side")), F.struct(F.col("next_low").alias("low"), F.lit(1).alias("side")))).alias("x"))
    sides = sides.select(work, "x.low", "x.side", "a", "b", "both", "pair")
    j = n.join(sides, [work, "low"], "left").withColumn("a", F.coalesce("a", "low"))
    fits = F.coalesce(2 * F.col("both") >= F.col("caps"), F.lit(False))
    j = j.withColumn("taken", F.min(fits).over(Window.partitionBy(work, "a", "b"))).withColumn("used", F.max("taken").over(Window.partitionBy(work, "low")))
    lower = F.col("total") - F.col("caps") - F.col("shouts")
    alone = (F.length("low") >= 2) & (F.col("mid") >= least) & ~unwanted("low") & (2 * F.col("shouts") <= F.col("total"))
    lone = F.struct(F.col("low").alias("a"), F.lit(None).cast("string").alias("b"), "name", F.col("mid").alias("mentions"), "total", (lower >= F.col("mid")).alias("in_dictionary"), F.col("low").isin(*places).alias("place"))
    half = F.struct("a", "b", F.col("pair").alias("name"), F.greatest("both", "mid").alias("mentions"), "total", F.lit(False).alias("in_dictionary"), F.col("low").isin(*places).alias("place"))
    each = j.select(work, F.when(F.col("taken"), half).when(~F.col("used") & alone, lone).alias("x")).where("x is not null").select(work, "x.*")
    # A word that stands in several pairs of which none is taken is there several times with the same counts.
    total = F.when(F.col("b").isNull(), F.max("total")).otherwise(F.sum("total"))
    found = each.groupBy(work, "a", "b").agg(F.max("name").alias("name"), F.max("mentions").alias("mentions"), total.alias("total"), F.max("in_dictionary").alias("in_dictionary"), F.max("place").alias("place"))
    score = F.col("mentions") * F.when(F.col("in_dictionary"), 1.0).otherwise(NAME_FACTOR) * F.when(F.col("place"), PLACE_FACTOR).otherwise(1.0)
    scored = found.select(work, "name", "mentions", "total", "in_dictionary", "place", F.round(score, 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(work).orderBy(F.desc("score"), "name"))).where(F.col("rank") <= most)

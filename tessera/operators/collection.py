"""Evidence for a logic: tiers of found pages filled up to caps, and checks of what pages are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text, urls

#: Pages read for a logic, sources kept for it, sources ranked at most. Fixed values.
READ, KEPT, RANKED = 5, 10, 24
#: Words that say nothing about a concept. Fixed values.
NO_CONCEPT = (
    "about across against based business climate companies company country current driver evidence global impact industry latest market policy "
    "requirement requirements sector selected source standard sustainability sustainable target targets through which with"
).split()


#: What page_keys leaves as it is: lower-case ASCII with a path and no query or fragment.
_PLAIN = r"""^[a-z][a-z0-9+.-]*://[!"$%'-.0->@\[-~]+/[!"$%'->@\[-~]*\z"""


def page_keys(url: Column) -> Column:
    """What makes two links one page, in an array: lower case, no fragment, no campaign parameters; an empty one for what is no URL."""
    full = F.regexp_replace(urls.dedup_key(url), r"^([a-z][a-z0-9+.-]*://[^/?]+)$", "$1/")
    key = F.when(url.rlike(_PLAIN), url).otherwise(full)
    return F.filter(F.array(key), lambda k: k.rlike(r"^[a-z][a-z0-9+.-]*://[^/?]+"))


def judged(items: DataFrame, kept: int = KEPT) -> DataFrame:
    """The sources of each logic and the pages turned down: logic_id, source_id, url, tier, score, reason (null for a source).

    ``items``: logic_id, tier (``seed``, ``publisher``, ``registry`` or ``search``), query (its number,
    from 0; 0 for other tiers), place, url, approved (by its URL), accepted (by its content), the marks
    authority, relevance, freshness and boost, and, if places repeat, line (which of equal links is first).

    A logic with seeds takes the first of READ seeds that is approved and accepted, alone. If there is
    none but one was approved, pages of the publisher tier that are no seeds follow, READ approved ones.
    Other logics read registry pages first, then search results: queries run while their results
    before (as many a query as places were open) are fewer pages than that, and READ approved pages
    are read in all. Accepted ones are ranked by score, kept and numbered. Pages count once a logic,
    where they come first; links that are no URLs don't count. Null flags are false, null marks 0.

    Rows travel once and are sorted three times whole (by tier, by page, by tier): every window names
    the whole order, so that those with one order share one sort.
    """
    flag, mark = (lambda c: F.coalesce(F.col(c), F.lit(False))), (lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double"))
    rank = F.when(F.col("tier") == "seed", 0).when(F.col("tier") == "publisher", 1).when(F.col("tier") == "registry", 2).otherwise(3)
    line = F.col("line") if "line" in items.columns else F.lit(0)
    base = F.round(mark("authority") * 0.45 + mark("relevance") * 0.35 + mark("freshness") * 0.2, 9)
    fit = (mark("relevance") >= 20) | (mark("authority") >= 75)
    rows = items.select(
        "logic_id", "tier", rank.alias("rank"), F.coalesce("query", F.lit(0)).alias("query"), "place", "url", line.alias("line"), F.explode(page_keys(F.col("url"))).alias("key"),
        flag("approved").alias("approved"), flag("accepted").alias("accepted"), fit.alias("fit"), base.alias("base"), mark("boost").alias("boost"),
    )
    order = ["rank", "query", "place", "url", "line"]
    start, end, here = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow
    by_tier = Window.partitionBy("logic_id").orderBy(*order)
    in_tier = Window.partitionBy("logic_id", "rank").orderBy(*order[1:])

    # A query gives as many results as places are open, READ at most.
    rows = rows.withColumn("_lead", F.first("rank").over(by_tier.rowsBetween(start, here))).filter((F.col("_lead") == 0) == (F.col("rank") <= 1))
    per_query = Window.partitionBy("logic_id", "rank", "query").orderBy(*order[2:])
    rows = rows.withColumn("_q", F.row_number().over(per_query)).filter((F.col("rank") < 3) | (F.col("_q") <= READ))

    # Pages of each tier once, so that a tier's caps count pages.
    first = Window.partitionBy("logic_id", "key", "rank").orderBy(*order[1:])
    by_page = Window.partitionBy("logic_id").orderBy("key", *order).rowsBetween(start, end)
    found = rows.withColumn("_n", F.row_number().over(first))
    known = (F.col("rank") == 2) & (F.col("_n") == 1) & F.col("approved")
    found = found.withColumn("open", READ - F.least(F.lit(READ), F.sum(known.cast("int")).over(by_page)))
    shown = found.filter((F.col("rank") < 3) | (F.col("_q") <= F.col("open"))).withColumn("_n", F.row_number().over(first))
    seen = Window.partitionBy("logic_id", "key").orderBy(*order)
    shown = shown.withColumn("_s", F.row_number().over(seen)).filter("_n = 1")

    # A query runs if the pages of those before are fewer; in the one list a logic reads, pages of an earlier tier don't come again.
    earlier = Window.partitionBy("logic_id", "rank").orderBy("query").rangeBetween(start, -1)
    shown = shown.withColumn("_opening", F.first("query").over(in_tier.rowsBetween(start, here))).withColumn("_before", F.count("*").over(earlier))
    listed = shown.filter((F.col("rank") < 3) | (F.col("query") == F.col("_opening")) | (F.col("_before") < F.col("open"))).filter("_s = 1")
    number = lambda c, w: F.coalesce(F.sum(c.cast("int")).over(w.rowsBetween(start, -1)), F.lit(0))
    good = F.col("approved") & F.col("accepted")
    listed = listed.withColumn("_place", F.row_number().over(in_tier)).withColumn("_good", number(good, in_tier))
    listed = listed.withColumn("_p", number(F.col("approved"), in_tier)).withColumn("_a", number(F.col("approved"), by_tier))
    seed_read = (F.col("rank") == 0) & (F.col("_place") <= READ) & (F.col("_good") == 0)
    whole = by_tier.rowsBetween(start, end)
    listed = listed.withColumn("_got", F.max(seed_read & good).over(whole)).withColumn("_any", F.max(seed_read & F.col("approved")).over(whole))
    read = F.when(F.col("rank") == 0, seed_read).when(F.col("rank") == 1, ~F.col("_got") & F.col("_any") & F.col("approved") & (F.col("_p") < READ)).otherwise(F.col("approved") & (F.col("_a") < READ))

    able = listed.filter(read).withColumn("_able", good & F.col("fit"))
    best = Window.partitionBy("logic_id").orderBy(F.desc("_able"), F.desc("base"), *order)
    able = able.withColumn("_b", F.row_number().over(best)).withColumn("_ranked", F.col("_able") & (F.col("_b") <= RANKED))
    able = able.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("base") + F.col("boost") + 0.5))).cast("int"))
    final = Window.partitionBy("logic_id").orderBy(F.desc("_ranked"), F.desc("score"), "_b")
    source = F.col("_ranked") & (F.col("_f") <= kept)
    return able.withColumn("_f", F.row_number().over(final)).filter(source | ~good).select(
        "logic_id", F.when(source, F.concat(F.lit("S"), F.col("_f").cast("string"))).alias("source_id"), "url", "tier", F.when(source, F.col("score")).alias("score"),
        F.when(~F.col("approved"), "not-approved").when(~F.col("accepted"), "not-accepted").alias("reason"),
    )


def collected(items: DataFrame, kept: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """``judged`` as two tables: (logic_id, source_id, url, tier, score) of the sources, (logic_id, url, tier, reason) of the rest."""
    pages = judged(items, kept)
    return pages.filter("reason is null").select("logic_id", "source_id", "url", "tier", "score"), pages.filter("reason is not null").select("logic_id", "url", "tier", "reason")


def concept_terms(body: Column, most: int = 16) -> Column:
    """The first different words that can name a concept: four characters or three letters, no numbers, no words for everything."""
    words = text.tokens(body)
    good = lambda w: ((F.length(w) >= 4) | w.rlike("^[a-z]{3}$")) & ~w.isin(NO_CONCEPT) & ~w.rlike(r"^\d+$")
    return F.slice(F.array_distinct(F.filter(words, good)), 1, most)


def concept_issue(page: Column, concept: Column, claims: Column) -> Column:
    """``concept`` or ``claim`` for what a page (text) does not match, null for a page that matches both.

    Of four or more concept terms two have to be there, of fewer one; of the claims that have terms
    (array of texts) one has to have two of its terms there, or its only one.
    """
    said = F.array_distinct(text.tokens(F.replace(F.coalesce(page, F.lit("")), F.lit("&"), F.lit(" and "))))
    hits = lambda terms: F.size(F.array_intersect(terms, said))
    terms = concept_terms(F.coalesce(concept, F.lit("")))
    needed = F.when(F.size(terms) >= 4, 2).when(F.size(terms) > 0, 1).otherwise(0)
    sets = F.filter(F.transform(F.coalesce(claims, F.array().cast("array<string>")), lambda c: concept_terms(F.coalesce(c, F.lit("")))), lambda t: F.size(t) > 0)
    met = F.exists(sets, lambda t: hits(t) >= F.least(F.lit(2), F.size(t)))
    return F.when(hits(terms) < needed, "concept").when((F.size(sets) > 0) & ~met, "claim")


def t_occurrence(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """set_id, text_id, hits: every text that has at least ``needed`` of a set's terms.

    ``sets``: set_id, terms (array), needed (1 or more); ``texts``: text_id, terms. A text with m of n
    terms lacks n - m, so it has one of any n - m + 1: texts are found by that many of the set's rarest
    terms, and frequent words only count. Repeated terms count once; sets that need more terms than they
    have find nothing.
    """
    wanted = sets.select("set_id", F.array_distinct("terms").alias("own"), "needed").filter((F.col("needed") >= 1) & (F.size("own") >= F.col("needed")))
    posted = texts.select("text_id", F.array_distinct("terms").alias("said"))
    postings = posted.select("text_id", F.explode("said").alias("term"))
    often = postings.groupBy("term").agg(F.count("*").alias("n"))
    asked = wanted.select("set_id", (F.size("own") - F.col("needed") + 1).alias("probes"), F.explode("own").alias("term")).join(often, "term", "left")
    rare = Window.partitionBy("set_id").orderBy(F.coalesce("n", F.lit(0)), "term")
    probes = asked.withColumn("_r", F.row_number().over(rare)).filter(F.col("_r") <= F.col("probes"))
    met = probes.join(postings, "term").select("set_id", "text_id").distinct().join(wanted, "set_id").join(posted, "text_id")
    hits = F.size(F.array_intersect("own", "said"))
    return met.withColumn("hits", hits).filter(F.col("hits") >= F.col("needed")).select("set_id", "text_id", "hits")


#: Characters a logic's term has at least, tokens of a page and of a publisher's name that are looked at, and the most points. Fixed values.
TERM_LENGTH, PAGE_TOKENS, NAME_TOKENS, MOST_BOOST = 5, 5000, 20, 18


def logic_boost(page: Column, priorities: Column, logic: Column) -> Column:
    """Points for a page that fits a logic: 8 if it names one of the priority publishers, 2 for each of the logic's terms, 10 at most for these."""
    said = text.tokens(F.coalesce(page, F.lit("")), PAGE_TOKENS)
    named = lambda p: (F.size(text.tokens(p, NAME_TOKENS)) > 0) & text.has_sequence(said, text.tokens(p, NAME_TOKENS))
    hit = F.exists(F.coalesce(priorities, F.array().cast("array<string>")), lambda p: F.coalesce(named(p), F.lit(False)))
    terms = F.array_distinct(F.filter(text.tokens(F.coalesce(logic, F.lit(""))), lambda w: F.length(w) >= TERM_LENGTH))
    hits = F.size(F.array_intersect(terms, said))
    return F.least(F.lit(MOST_BOOST), F.when(hit, 8).otherwise(0) + F.least(hits * 2, F.lit(10)))


def boosted(score: Column, boost: Column) -> Column:
    """A score with points, rounded half up, from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + boost + 0.5))).cast("int")

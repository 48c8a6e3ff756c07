"""Names found in texts: lookups by prefix and part, resolution of questions to anchors, what is known about a problem.

anchors: id, canonical, maturity. All questions are resolved at once.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that name no concept in a question, and words between the two sides of a comparison.
STOP = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "what", "who", "where", "when", "why", "how", "which", "tell", "me", "about", "explain", "describe", "define",
    "do", "does", "did", "can", "could", "would", "should", "know", "think", "believe", "understand", "mean", "means", "have", "has", "had", "please", "give", "show",
    "i", "you", "we", "they", "it", "my", "your", "its", "this", "that", "these", "those", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "not", "no", "any", "some", "all", "more", "most",
]
BETWEEN = "(?i)\\b(linked to|related to|connected to|affect|affects|influence|link to|compared to|versus|vs|and)\\b"


def pairs_of_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer of each turn of a user that has a next turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.withColumn("answer", F.lead("text").over(w)).where("role = 'user' AND answer IS NOT NULL").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def grams(text: Column, size: int) -> Column:
    """The distinct strings of `size` characters in text."""
    return F.when(F.length(text) < size, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))))


def containing(terms: DataFrame, names: DataFrame) -> DataFrame:
    """term and the columns of names(name, ...) that hold each of terms(term), of two characters or more, which are distinct.

    Joined by the term's rarest string of three characters (of two, if it has no more), not by comparing all with all. Spark takes exploded rows to be as few as the names they come from and would broadcast them: they
    are merged.
    """
    own = names.select(*names.columns, F.explode(F.concat(grams(F.col("name"), 3), grams(F.col("name"), 2))).alias("gram")).hint("merge")
    asked = terms.select("term", F.explode(F.when(F.length("term") > 2, grams(F.col("term"), 3)).otherwise(grams(F.col("term"), 2))).alias("gram"))
    often = own.groupBy("gram").agg(F.count("*").alias("_n"))  # as many as there are different strings of two or three characters
    rarest = asked.join(often, "gram").groupBy("term").agg(F.min(F.struct("_n", "gram")).alias("x")).select("term", "x.gram")
    return rarest.join(own, "gram").where(F.contains("name", "term")).select("term", *names.columns)


def lookup(tokens: DataFrame, anchors: DataFrame, limit: int = 8, few: int = 3) -> DataFrame:
    """token, id, canonical, maturity, tier, place: the `limit` anchors of greatest maturity that start with a token (tier 0), and if these are fewer than `few`, after them those that hold it (tier 1).

    Of the anchors of one name only the best `limit` can be among a token's, so only these are joined.
    """
    named = anchors.select("id", "canonical", "maturity", F.lower("canonical").alias("name"))
    sizes = named.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("_size"))
    found = containing(tokens.select(F.col("token").alias("term")).distinct(), sizes.select("name")).withColumn("tier", F.when(F.startswith("name", "term"), 0).otherwise(1))
    enough = found.where("tier = 0").join(sizes.hint("merge"), "name").groupBy("term").agg(F.sum("_size").alias("_p"))
    own = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("maturity"), "id"))
    best = named.withColumn("_own", own).where(F.col("_own") <= limit).drop("_own").hint("merge")
    rank = F.row_number().over(Window.partitionBy("term").orderBy("tier", F.desc("maturity"), "id"))
    rows = found.join(enough, "term", "left").where((F.col("tier") == 0) | (F.coalesce("_p", F.lit(0)) < few)).join(best, "name")
    return rows.withColumn("place", rank).where(F.col("place") <= limit).select(F.col("term").alias("token"), "id", "canonical", "maturity", "tier", "place")


def normalized(text: Column) -> Column:
    """Lower case, marks as blanks, blanks made one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\w\\s]", " "), "\\s+", " "))


def candidates(text: Column, longest: int = 4) -> Column:
    """array<string>, best first: the normalized text, what stop words leave of it, and its windows of up to `longest` words, longest and leftmost first."""
    norm = normalized(text)
    w = F.split(norm, " ")
    stripped = F.array_join(F.filter(w, lambda x: ~x.isin(STOP)), " ")
    size = F.least(F.lit(longest), F.size(w))
    windows = F.flatten(F.transform(F.sequence(size, F.lit(1), F.lit(-1)), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    return F.filter(F.concat(F.array(norm, stripped), F.filter(windows, lambda x: ~x.isin(STOP))), lambda x: F.length(x) >= 2)


def resolve(questions: DataFrame, anchors: DataFrame) -> DataFrame:
    """query_id, term, id, maturity of questions(query_id, text) that name an anchor: by the first candidate that is one, starts one or lies in one; of those, the anchor of greatest maturity (ties: least id)."""
    asked = questions.select("query_id", F.posexplode(candidates(F.col("text"))).alias("order", "term"))
    first = F.min(F.struct((-F.col("maturity")).alias("m"), "id"))
    names = anchors.where("canonical IS NOT NULL").groupBy(F.lower("canonical").alias("name")).agg(first.alias("own"))
    tier = F.when(F.col("name") == F.col("term"), 0).when(F.startswith("name", "term"), 1).otherwise(2)
    best = containing(asked.select("term").distinct(), names.select("name")).join(names.hint("merge"), "name").groupBy("term").agg(F.min(F.struct(tier.alias("tier"), "own.m", "own.id")).alias("x"))
    found = asked.join(best, "term").groupBy("query_id").agg(F.min(F.struct("order", "term", "x")).alias("y"))
    return found.select("query_id", "y.term", "y.x.id", (-F.col("y.x.m")).alias("maturity"))


def resolve_pairs(questions: DataFrame, anchors: DataFrame) -> DataFrame:
    """query_id, left_id, right_id: both sides of a comparison resolved; without a word between sides the whole question is the left one."""
    sides = F.split(F.col("text"), BETWEEN, 2)
    parts = questions.select("query_id", F.posexplode(sides).alias("side", "part")).select(F.struct("query_id", "side").alias("query_id"), F.trim("part").alias("text"))
    found = resolve(parts, anchors).select("query_id.query_id", "query_id.side", "id")
    of = lambda k: F.max(F.when(F.col("side") == k, F.col("id")))
    sums = found.groupBy("query_id").agg(of(0).alias("left_id"), of(1).alias("right_id"))
    return questions.select("query_id").join(sums, "query_id", "left")


def member_ngrams(texts: DataFrame, anchors: DataFrame, longest: int = 2) -> DataFrame:
    """query_id, ngram, position, id: n-grams of texts(query_id, text) that are an anchor's name, by their place from the left; the least id of equals."""
    w = F.split(normalized(F.col("text")), " ")
    found = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size(w) < n, F.array().cast("array<struct<position:int,ngram:string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(i.alias("position"), F.array_join(F.slice(w, i, n), " ").alias("ngram"))))))
    named = anchors.groupBy(F.lower("canonical").alias("ngram")).agg(F.min("id").alias("id"))
    return texts.select("query_id", F.explode(found).alias("x")).select("query_id", "x.*").join(named, "ngram").select("query_id", "ngram", "position", "id")


def problem_tokens(text: Column, noise: list[str], most: int | None = None) -> Column:
    """Tokens of a problem: words, and parts of words with underscores before them; longer than two characters, without noise, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    each = F.flatten(F.transform(found, lambda x: F.when(x.contains("_"), F.concat(F.split(x, "_"), F.array(x))).otherwise(F.array(x))))
    kept = F.filter(each, lambda x: ~x.isin(noise) & (F.length(x) > 2))
    return F.slice(kept, 1, most) if most else kept


def knowledge(problems: DataFrame, anchors: DataFrame, edges: DataFrame, noise: list[str], most_tokens: int = 12, per_token: int = 4, most_anchors: int = 20) -> DataFrame:
    """query_id, n_anchors, n_relations, confidence, has_knowledge of problems(query_id, text): half the share of tokens met, 0.3 of the anchors' mean maturity (of 50), 0.2 of the relations of the first anchors (of 10).

    edges: subject_id, predicate, object_id, unique.
    """
    asked = problems.withColumn("_all", problem_tokens(F.col("text"), noise))
    tokens = asked.select("query_id", F.posexplode(F.slice("_all", 1, most_tokens)).alias("at", "token"))
    # a prefix: joined by the anchors' own starts, one for each length that a token has
    lengths = F.array_distinct(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("canonical"))), lambda n: F.lower(F.substr("canonical", F.lit(1), n))))
    starts = anchors.select("id", "canonical", "maturity", F.explode(lengths).alias("token")).hint("merge")  # many rows a name, so not broadcast
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("maturity"), "id"))
    hits = tokens.select("token").distinct().join(starts, "token").withColumn("place", rank).where(F.col("place") <= per_token)
    own = tokens.join(hits, "token").groupBy("query_id", "id", "canonical", "maturity").agg(F.min(F.struct("at", "place")).alias("order"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("order", "id")))
    met = own.join(asked.select("query_id", F.array_distinct("_all").alias("_set")), "query_id")
    sums = met.groupBy("query_id").agg(F.count("*").alias("n_anchors"), F.count_if(F.exists("_set", lambda t: F.contains("canonical", t))).alias("matched"), F.max(F.size("_set")).alias("n_tokens"), F.avg("maturity").alias("mean"))
    first = own.where(F.col("place") <= most_anchors).select("query_id", "id")
    ends = edges.select(F.col("subject_id").alias("id"), "subject_id", "predicate", "object_id").union(edges.select("object_id", "subject_id", "predicate", "object_id"))
    touched = first.join(ends, "id").select("query_id", "subject_id", "predicate", "object_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_relations"))
    n, one = F.coalesce("n_relations", F.lit(0)), F.lit(1.0)
    score = F.round(0.5 * F.col("matched") / F.greatest("n_tokens", F.lit(1)) + 0.3 * F.least(F.col("mean") / 50, one) + 0.2 * F.least(n / 10, one), 3)
    return sums.join(touched, "query_id", "left").select("query_id", "n_anchors", n.alias("n_relations"), score.alias("confidence"), ((score >= 0.25) & (F.col("n_anchors") >= 2)).alias("has_knowledge"))


def memory_search(questions: DataFrame, anchors: DataFrame, edges: DataFrame, noise: list[str], limit: int = 10, most_tokens: int = 6) -> DataFrame:
    """query_id, subject_id, predicate, object_id, place: the relations of anchors that a question's words look up, most seen first, then surest; without any, those of the question's domain.

    questions: query_id, text, domain (null: none); edges: subject_id, predicate, object_id (unique), domain, confidence, seen.
    """
    kept = F.filter(F.split(F.lower("text"), "\\s+"), lambda x: (F.length(x) > 3) & ~x.isin(noise))
    tokens = questions.select("query_id", F.explode(F.array_distinct(F.slice(kept, 1, most_tokens))).alias("token"))
    found = tokens.join(lookup(tokens.select("token").distinct(), anchors), "token").select("query_id", "id").distinct()
    key = ["subject_id", "predicate", "object_id", "domain", "confidence", "seen"]
    ends = edges.select(F.col("subject_id").alias("id"), *key).union(edges.where("subject_id <> object_id").select(F.col("object_id").alias("id"), *key))
    direct = found.join(ends, "id").select("query_id", *key).distinct().join(questions.select("query_id", F.col("domain").alias("wanted")), "query_id").where(F.col("wanted").isNull() | F.contains("domain", "wanted")).drop("wanted")
    by_domain = questions.where("domain IS NOT NULL").select("query_id", "domain").join(direct.select("query_id").distinct(), "query_id", "left_anti").join(edges, "domain").select("query_id", *key)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("seen"), F.desc("confidence"), "subject_id", "predicate", "object_id"))
    return direct.unionByName(by_domain).withColumn("place", rank).where(F.col("place") <= limit).select("query_id", "subject_id", "predicate", "object_id", "place")

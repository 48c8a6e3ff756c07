"""Filters and verdicts over names, texts and edges, as column expressions."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that neither start nor end a concept; families of domains that a kind should not cross; words about words.
EDGE_STOP = ["a", "an", "the", "of", "and", "or", "in", "on", "to", "for", "with", "by", "as", "at", "from", "its", "it", "is", "are", "was", "be"]
TAXONOMIC = ["is_a", "part_of", "same_as", "facet_of", "derived_from"]
FAMILIES = [
    ["paleontology", "geology", "fossil", "stratigraphy", "sediment"],
    ["astronomy", "galaxy", "nebula", "pulsar", "quasar", "cosmology"],
    ["botany", "mycology", "entomology", "ornithology", "herpetology"],
    ["topology", "algebra", "calculus", "geometry", "combinatorics"],
    ["psychology", "psychiatry", "neuroscience", "cognition"],
    ["economics", "finance", "macroeconomics", "microeconomics"],
]
# What a gap's name must not start with, and other domains under which a sense is known.
GAP_NOISE = "(?i)^(his |her |our |your |their |the |upon |between |likewise |numerou|- |\\w+ itself$|idea or |unavoidable )"
ALIASES = {"economics": ["finance", "financial", "economic"], "computer science": ["computing", "programming", "software"], "linguistics": ["language", "phonology", "syntax", "morphology"], "medicine": ["medical", "clinical", "pharmacology"]}
# Categories that no abstract term belongs to, and kinds that are no abstract term.
NOT_KINDS, NOT_MEMBERS = ["disease", "physics", "cancer", "compound", "drug"], ["disease", "cancer", "compound", "drug", "tumor"]
# Predicates that speak for relevance, and against it; those to be told with care; objects too.
HIGH_SIGNAL = [
    "causes", "enables", "produces", "requires", "uses", "used_for", "regulates", "inhibits", "activates", "prevents", "triggers", "contains", "part_of", "context_of", "supports", "validates",
    "depends_on", "transforms", "calls", "consumes", "fails_on", "incompatible_with", "preferred_over",
]
LOW_SIGNAL = ["related_to", "is_a", "also_known_as", "same_as", "co_occurs_with", "associated_with", "mentioned_with"]
SENSITIVE, SENSITIVE_OBJECTS = ["can_cause", "may_cause", "associated_with_risk"], ["cancer", "tumor", "death", "toxin", "radiation"]
PILLARS = {
    "truth": ["truth", "honest", "honesty", "certainty", "fact", "valid"],
    "non_harm": ["harm", "damage", "hurt", "injury", "danger", "risk", "safe"],
    "coherence": ["coherence", "consistent", "consistency", "logic", "rational"],
    "epistemology": ["knowledge", "knowing", "belief", "evidence", "certainty", "epistemology"],
    "freewill": ["free_will", "freedom", "agency", "autonomy", "choice", "will"],
    "autonomous_consent": ["consent", "agreement", "permission", "autonomy", "boundary"],
}
PILLAR_PREDICATES = {
    "truth": ["context_of", "supports", "validates", "requires", "defines"],
    "non_harm": ["causes", "affects", "impacts", "enables", "prevents"],
    "freewill": ["enables", "constrains", "requires"],
    "epistemology": ["requires", "produces", "validates", "context_of"],
}


def any_of(tests) -> Column:
    return reduce(or_, tests, F.lit(False))


def all_of(tests) -> Column:
    return reduce(and_, tests, F.lit(True))


def contains_any(text: Column, terms: list[str]) -> Column:
    return any_of(text.contains(t) for t in terms)


def words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


def valid_concept(name: Column) -> Column:
    """3 to 80 characters, one to six words, the first and last of them no stop word; null is not valid."""
    w = words(F.lower(name))
    stop = lambda i: F.coalesce(F.try_element_at(w, F.lit(i)).isin(EDGE_STOP), F.lit(True))
    return F.coalesce(F.length(name).between(3, 80) & (F.size(w) <= 6) & ~stop(1) & ~stop(-1), F.lit(False))


def clean_gap(name: Column) -> Column:
    """A gap's name: 4 to 28 characters without digits or outer blanks, no noise at its start, no capital at the start of a word of several, no word of one letter."""
    w = words(name)
    titled = (F.size(w) >= 2) & F.exists(w, lambda x: x.rlike("^\\p{Lu}"))
    return F.length(name).between(4, 28) & ~name.rlike("[0-9]") & (F.trim(name) == name) & ~name.rlike(GAP_NOISE) & ~titled & ~F.exists(w, lambda x: F.length(x) <= 1)


def domain_noise(s: Column, p: Column, o: Column) -> Column:
    """A kind that crosses families: the object is of a family, the subject of none."""
    return p.isin(TAXONOMIC) & any_of(contains_any(F.lower(o), f) for f in FAMILIES) & ~any_of(contains_any(F.lower(s), f) for f in FAMILIES)


def incoherent(term: Column, s: Column, p: Column, o: Column) -> Column:
    """An is_a that makes the term one of its non-categories, or one of its non-members a kind of the term."""
    q = F.replace(F.lower(term), F.lit("_"), F.lit(" "))
    return (p == "is_a") & (((s == q) & F.lower(o).isin(NOT_KINDS)) | ((o == q) & F.lower(s).isin(NOT_MEMBERS)))


def pillar(term: Column) -> Column:
    """The first pillar with a word that the term starts with; null if none."""
    t = F.replace(F.lower(term), F.lit("_"), F.lit(" "))
    return F.coalesce(*[F.when(any_of(t.startswith(x) for x in own) | t.isin(own), F.lit(k)) for k, own in PILLARS.items()])


def reranked(term: Column, s: Column, p: Column, o: Column, strength: Column) -> Column:
    """A chain's strength: 0.05 of it if incoherent, 1.4 or 0.7 by the predicate's signal, 1.5 by the term's pillar."""
    own = pillar(term)
    boost = reduce(lambda c, kv: c.when((own == kv[0]) & p.isin(kv[1]), 1.5), PILLAR_PREDICATES.items(), F)
    return strength * F.when(incoherent(term, s, p, o), 0.05).otherwise(1.0) * F.when(p.isin(HIGH_SIGNAL), 1.4).when(p.isin(LOW_SIGNAL), 0.7).otherwise(1.0) * boost.otherwise(1.0)


def sensitive(p: Column, o: Column) -> Column:
    return p.isin(SENSITIVE) | F.lower(o).isin(SENSITIVE_OBJECTS)


def topical_terms(query: Column, stop: list[str], least: int = 3) -> Column:
    """The query's terms, distinct, without stop words and shorter ones."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(stop) & (F.length(x) >= least)))


def in_focus(text: Column, terms: Column) -> Column:
    """The text holds a term; without terms everything is in focus."""
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(F.lower(text), t))


def voice(text: Column, speaker: str, reflects: str, noise: str, letters: float = 0.68, most_bars: int = 2) -> Column:
    """A text in a speaker's own voice: no table, no noise, enough letters, a mark of the speaker and one of reflection (patterns)."""
    n = F.length(text)
    bars = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    alpha = F.length(F.regexp_replace(text, "[^\\p{L} ]", ""))
    return ~text.rlike("\\|.*\\|") & (bars <= most_bars) & ~text.rlike(noise) & (n > 0) & (alpha >= letters * n) & text.rlike(speaker) & text.rlike(reflects)


def review_relations(content: Column, off_topic: list[str], system: list[str]) -> Column:
    """struct<status, note> of relations as JSON: 1 approved, 2 rejected. One off-topic relation rejects all; else one of the system is enough."""
    rels = F.coalesce(F.from_json(content, "struct<relations: array<struct<subject: string, predicate: string, object: string>>>")["relations"], F.array().cast("array<struct<subject: string, predicate: string, object: string>>"))
    triple = lambda r: F.concat_ws(" ", r["subject"], r["predicate"], r["object"])
    off = F.filter(rels, lambda r: contains_any(F.lower(triple(r)), off_topic))
    known = lambda r: contains_any(F.lower(r["subject"]), system) | contains_any(F.lower(r["object"]), system)
    good, other = F.size(F.filter(rels, known)), F.filter(rels, lambda r: ~known(r))
    first = lambda a: F.substring(triple(F.try_element_at(a, F.lit(1))), 1, 60)
    verdict = lambda status, note: F.struct(F.lit(status).alias("status"), note.alias("note"))
    return (F.when(F.size(rels) == 0, verdict(2, F.lit("empty relations array"))).when(F.size(off) > 0, verdict(2, F.concat(F.lit("off-topic relations: "), first(off))))
            .when(good == 0, verdict(2, F.lit("no system relations"))).when(F.size(other) > 0, verdict(1, F.concat(F.lit("approved (ignored: "), first(other), F.lit(")")))).otherwise(verdict(1, F.lit("approved"))))


def acceptance(known: Column, term: Column, patterns: list[str], anchors: list[str], score: Column) -> Column:
    """accepted, pending or rejected: three, two or fewer of known, a pattern in it, an anchor in it or around it, and a score over 0.5."""
    passed = sum(x.cast("int") for x in (known, contains_any(term, patterns), any_of(term.contains(a) | F.lit(a).contains(term) for a in anchors), score > 0.5))
    return F.when(passed >= 3, "accepted").when(passed == 2, "pending").otherwise("rejected")


def sense_rank(domain: Column, active: Column) -> Column:
    """How well a sense's domain fits the active one: 0 exactly, 1 by an alias, 2 as a part, 3 not (also without an active domain)."""
    d, a = F.lower(domain), F.lower(active)
    group = lambda x: F.coalesce(*[F.when((x == k) | x.isin(own), F.lit(k)) for k, own in ALIASES.items()])
    rank = F.when(d == a, 0).when(group(d) == group(a), 1).when(d.contains(a) | a.contains(d), 2)
    return F.when(domain.isNull() | active.isNull() | (domain == "") | (active == ""), 3).otherwise(F.coalesce(rank, F.lit(3)))

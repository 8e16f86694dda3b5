"""Classification of query strings by rules, as one expression over a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_B, _E = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"


def words(*alternatives: str) -> str:
    return f"{_B}(?:{'|'.join(alternatives)}){_E}"


# Our own patterns, in the order in which types are tried. They apply to lower-cased queries.
FAMILIES = {
    "conversational": (r"^(?:hi|hello|hey|thanks|thank you|bye|good (?:morning|evening|night)|ok|okay|yes|no)(?![a-z0-9_])", words("how are you", "nice to meet you")),
    "navigational": (words("where (?:is|are|can i find|do i find)", "locate", "which (?:file|page|section|chapter)"), words("go to", "take me to", "link to", "show me the (?:file|page|section)")),
    "procedural": (words("how (?:to|do i|do we|can i|should i)"), words("steps? (?:to|for)", "instructions", "guide", "tutorial", "set ?up", "install", "configure", "fix", "troubleshoot"), r"^(?:create|build|make|add|remove|replace|repair)(?![a-z0-9_])"),
    "conceptual": (words("why", "explain", "difference between", "compare", "versus", "pros and cons", "relationship between"), words("concept", "theory", "principle", "overview", "about", "notes on")),
    "factual": (words("what (?:is|are|was|were)", "who", "when", "how (?:many|much|long|old)", "define", "definition"), r"\?\s*$"),
}
SUBTYPES = {
    "factual": (("definition", words("what (?:is|are)", "define", "definition", "meaning")), ("quantitative", words("how (?:many|much|long|old|often)", "number of", "count") + r"|\d"), ("temporal", words("when", "date", "year", "since", "until") + r"|(?<!\d)(?:19|20)\d\d(?!\d)")),
    "procedural": (("troubleshooting", words("fix", "troubleshoot", "error", "broken", "repair", "fails?", "problem")), ("step_by_step", words("how to", "steps?", "guide", "tutorial", "instructions"))),
}
ARITHMETIC = r"^[\s\d.+*/()=-]+\??$|" + words(r"\d+ (?:plus|minus|times|divided by) \d+")
GENERAL = words("capital of", "what day is it", "what time is it", "tell me a joke", "weather")
DOCUMENT = words("document", "documents", "manual", "handbook", "report", "section", "chapter", "page", "policy", "appendix", "according to")
FOLLOW_UP = r"^(?:and|also|what about|how about|it|that|this|they|those)(?![a-z0-9_])"
CODE = r"[a-z_]+\(\)|[a-z0-9]+_[a-z0-9_]+|\.(?:py|ts|js|go|rs|java|json|md)(?![a-z0-9_])|::|=>"
COMPLEX = words("compare", "analy[sz]e", "evaluate", "trade-?offs?", "in detail", "comprehensive") + "|" + words("and") + ".*" + words("and") + ".*" + words("and")
MEDIUM = words("explain", "describe", "summari[sz]e", "difference", "why", "how", "between")
ACRONYM = r"(?<![A-Za-z0-9_])[A-Z]{2,6}(?![A-Za-z0-9_])"


def _any(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def classify(query: Column, domain: Column | None = None, collections: Column | None = None, history: Column | None = None) -> Column:
    """struct<needs_retrieval, confidence, type, subtype, complexity, top_k, mode, reasoning> of one query.

    Context is optional: a domain name, an array of collections, an array of former queries. A null
    query counts as an empty one, which is conversational and needs no retrieval.
    """
    q = F.coalesce(query, F.lit(""))
    low = F.trim(F.lower(q))
    n_words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    kind = None
    for name in FAMILIES:
        hit = _any(low, FAMILIES[name])
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    kind = kind.when((F.length(low) < 10) & ~low.rlike(r"\p{L}{3}"), "conversational").otherwise("factual")
    subtype = F.lit(None).cast("string")
    for name, rules in SUBTYPES.items():
        chosen = F.coalesce(*[F.when(low.rlike(p), F.lit(s)) for s, p in rules])
        subtype = F.when(kind == name, chosen).otherwise(subtype)
    complexity = F.when(low.rlike(COMPLEX), "complex").when(low.rlike(MEDIUM) | (n_words > 20), "medium").otherwise("simple")
    given = lambda c: F.lit(False) if c is None else F.coalesce(F.size(c) > 0, F.lit(False))
    has_domain = F.lit(False) if domain is None else F.coalesce(F.length(F.trim(domain)) > 0, F.lit(False))
    code = low.rlike(CODE) | q.rlike(r"[a-z][A-Z][a-z]")
    needs = (
        F.when((kind == "conversational") | low.rlike(ARITHMETIC) | low.rlike(GENERAL), False)
        .when(has_domain | low.rlike(DOCUMENT) | given(collections) | (low.rlike(FOLLOW_UP) & given(history)) | kind.isin("navigational", "conceptual", "procedural") | (complexity != "simple") | code | q.rlike(ACRONYM), True)
        .otherwise(False)
    )
    matches = sum((p for ps in FAMILIES.values() for p in [_any(low, ps).cast("int")]), F.lit(0))
    confidence = F.least(F.lit(1.0), F.lit(0.7) + F.when(matches > 1, 0.15).when(matches == 1, 0.1).otherwise(0.0) + F.when(has_domain, 0.05).otherwise(0.0))
    top_k = F.when(needs, F.when(complexity == "simple", 3).when(complexity == "medium", 7).otherwise(15))
    mode = F.when(needs, F.when(code, "keyword").when(kind == "conceptual", "semantic").otherwise("hybrid"))
    reasoning = F.concat_ws(" ", F.concat(F.initcap(kind), F.lit(" query,")), F.concat(complexity, F.lit(",")), F.when(subtype.isNotNull(), F.concat(subtype, F.lit(","))), F.when(needs, "retrieval needed.").otherwise("no retrieval needed."))
    return F.struct(needs.alias("needs_retrieval"), F.round(confidence, 2).alias("confidence"), kind.alias("type"), subtype.alias("subtype"), complexity.alias("complexity"), top_k.alias("top_k"), mode.alias("mode"), reasoning.alias("reasoning"))

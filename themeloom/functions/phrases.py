"""Theme phrases and search queries as column expressions over small arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.functions import text
from themeloom.functions.binding import let

Forms = Mapping[str, tuple[str, str, str, str]]


def _forms_map(forms: Forms) -> Column:
    parts = []
    for topic, (role, noun, compound, adjective) in forms.items():
        parts += [F.lit(topic), F.struct(
            F.lit(topic).alias("topic"), F.lit(role).alias("role"), F.lit(noun).alias("noun"),
            F.lit(compound).alias("compound"), F.lit(adjective).alias("adjective"))]
    return F.create_map(*parts)


def compose_phrase(topics: Column, forms: Forms = K.TOPIC_FORMS,
                   heads: Mapping[str, str] = K.MEDIUM_HEADS) -> Column:
    """Phrase for topics in order of weight, by the role each topic plays.

    Medium, qualifier and domain give "<domains> about <adjectives> <medium>"; medium and domain a
    compound noun; qualifier and domain a field of research; otherwise nouns joined by "and".
    """
    table = _forms_map(forms)
    found = F.filter(F.transform(topics, lambda t: F.try_element_at(table, t)),
                     lambda f: f.isNotNull())
    return let(found, lambda known: _phrase(known, heads))


def _phrase(known: Column, heads: Mapping[str, str]) -> Column:
    def of_role(role: str) -> Column:
        return F.filter(known, lambda f: f["role"] == role)

    def joined(items: Column, form: str) -> Column:
        return F.array_join(F.transform(items, lambda f: f[form]), K.PHRASE_AND)

    medium = F.try_element_at(of_role("medium"), F.lit(1))
    qualifiers, domains = of_role("qualifier"), of_role("domain")
    has_domain, has_qualifier = F.size(domains) > 0, F.size(qualifiers) > 0
    described = F.concat_ws(" ", F.array_join(F.transform(qualifiers, lambda f: f["adjective"]),
                                              " "), medium["noun"])
    head = medium["noun"]
    for topic, plural in heads.items():
        head = F.when(medium["topic"] == topic, F.lit(plural)).otherwise(head)
    return (
        F.when(medium.isNotNull() & has_qualifier & has_domain,
               F.concat(joined(domains, "noun"), F.lit(K.PHRASE_ABOUT), described))
        .when(medium.isNotNull() & has_qualifier, described)
        .when(medium.isNotNull() & has_domain,
              F.concat_ws(" ", joined(domains, "compound"), head))
        .when(medium.isNotNull(), medium["noun"])
        .when(has_qualifier & has_domain,
              F.concat(joined(domains, "noun"), F.lit(K.PHRASE_FIELD),
                       qualifiers[0]["adjective"], F.lit(K.PHRASE_RESEARCH)))
        .otherwise(joined(known, "noun"))
    )


def theme_label(topics: Column, focus: Column, uncertain: Column,
                uncertain_label: str = K.UNCERTAIN_LABEL) -> Column:
    """``A + B``, ``A > focus`` or the uncertain label."""
    names = F.array_join(topics, " + ")
    return (F.when(uncertain | (F.size(topics) == 0), F.lit(uncertain_label))
            .when(focus.isNotNull(), F.concat(names, F.lit(K.JOINT_SEPARATOR), focus))
            .otherwise(names))


def query_form(token: Column) -> Column:
    """Search form of a normalised token: finite verbs give null, case endings are cut."""
    stripped = F.regexp_replace(token, K.CASE_SUFFIX_PATTERN, "")
    verb = (F.length(token) >= K.FINITE_VERB_MIN_CHARS) & token.rlike(K.FINITE_VERB_PATTERN)
    return F.when(~verb, F.when(F.length(stripped) >= K.MIN_STEM_CHARS, stripped).otherwise(token))


def build_query(core: Column, active: Column, keywords: Column,
                fillers: Sequence[str] = K.FILLER_WORDS) -> Column:
    """Theme words plus up to two new keywords; null without an active theme.

    ``core`` is the focus subtopic or the phrase.  Keywords whose stem is already in the query
    are skipped, and a theme of three or more words takes none.
    """
    base = F.filter(text.words(text.normal_form(core)), lambda w: ~w.isin(*fillers))
    start = F.struct(
        base.alias("words"), F.transform(base, lambda w: text.f5_stem(w)).alias("stems"),
        F.when(F.size(base) >= K.LONG_CORE_WORDS, 0).otherwise(K.MAX_QUERY_KEYWORDS)
        .alias("budget"))

    def add(state: Column, keyword: Column) -> Column:
        form = query_form(text.normal_form(keyword))
        usable = ((state["budget"] > 0) & F.coalesce(form != "", F.lit(False))
                  & ~F.array_contains(state["stems"], F.coalesce(text.f5_stem(form), F.lit(""))))
        return F.when(usable, F.struct(
            F.array_append(state["words"], form).alias("words"),
            F.array_append(state["stems"], text.f5_stem(form)).alias("stems"),
            (state["budget"] - 1).alias("budget"))).otherwise(state)

    found = F.coalesce(keywords, F.array().cast("array<string>"))
    whole = F.aggregate(found, start, add, lambda s: F.array_join(s["words"], " "))
    cut = F.regexp_replace(F.substring(whole, 1, K.MAX_QUERY_CHARS), " [^ ]*$", "")
    query = F.when(F.length(whole) > K.MAX_QUERY_CHARS, cut).otherwise(whole)
    return F.when(active & (query != ""), query)

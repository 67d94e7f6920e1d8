"""Column functions on query text: intent, depth, expansion, query building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions.text import count_of

#: Intents in order of preference, with the substrings that speak for them. Fixed values.
INTENTS = {
    "treatment": ("antibiotic", "treat", "regimen", "dose", "dosing", "ampicillin", "gentamicin", "benzylpenicillin", "amoxicillin", "cloxacillin", "give", "administer", "prescrib", "start", "initiat", "manage", "recommend", "should", "what to do", "how to treat"),
    "diagnosis": ("diagnos", "is this", "is it", "criteria", "confirm", "blood culture", "identify", "detect", "screen"),
    "risk_assessment": ("risk factor", "at risk", "risk of", "likelihood", "probability", "prom", "gbs", "chorioamnionitis", "rom", "rupture of membrane", "iap", "intrapartum"),
    "monitoring": ("monitor", "follow up", "follow-up", "review", "check", "reassess", "serial", "watch", "crp", "repeat", "interval"),
    "definition": ("what is", "define", "definition", "explain", "overview", "background", "epidemiology"),
}
CROSS_TERMS = ("who", "aap", "nice", "compare", "versus", "vs", "both guidelines")
MULTI_TERMS = ("and", "also", "plus", "as well", "additionally", "combination")
#: Clusters of terms that stand for one another; fixed values.
SYNONYMS = (
    ("early onset sepsis", "early-onset neonatal sepsis", "early-onset sepsis", "eos", "neonatal bacteremia", "neonatal infection", "neonatal sepsis", "newborn blood infection", "newborn infection", "newborn sepsis"),
    ("gbs", "group b strep", "group b streptococcus", "streptococcus agalactiae"),
    ("membrane rupture", "prelabor rupture of membranes", "premature rupture of membranes", "prolonged rupture of membranes", "prom", "rom", "rupture of membranes"),
    ("amnionitis", "chorioamnionitis", "intra-amniotic infection", "intraamniotic infection", "womb infection"),
    ("c reactive protein", "c-reactive protein", "crp", "inflammatory marker"),
    ("pct", "procalcitonin"),
    ("cbc", "complete blood count", "fbc", "full blood count", "leukocyte count", "wbc", "white blood cell count", "white cell count"),
    ("i:t ratio", "immature to total ratio", "immature-to-total neutrophil ratio", "it ratio"),
    ("iap", "intrapartum antibiotic prophylaxis", "intrapartum antibiotics", "maternal antibiotics", "peripartum antibiotics"),
    ("abx", "antibiotic therapy", "antibiotics", "antimicrobial therapy", "empiric antibiotics", "empirical antibiotics"),
    ("amoxicillin", "ampicillin"),
    ("benzylpenicillin", "penicillin", "penicillin g"),
    ("aminoglycoside", "gentamicin"),
    ("bacteremia", "blood culture", "blood cultures", "culture-positive"),
    ("breathing difficulty", "grunting", "increased work of breathing", "respiratory distress", "tachypnea", "tachypnoea"),
    ("continuous positive airway pressure", "cpap", "mechanical ventilation", "oxygen requirement", "respiratory support", "supplemental oxygen"),
    ("hypothermia", "low temperature", "temperature instability"),
    ("fever", "hyperthermia", "intrapartum fever", "maternal fever", "pyrexia"),
    ("floppy", "hypotonia", "irritability", "lethargy", "poor tone", "reduced activity"),
    ("capillary refill", "hypotension", "poor perfusion", "shock"),
    ("apgar", "apgar score"),
    ("premature", "prematurity", "preterm", "preterm birth"),
    ("low platelets", "platelet count", "thrombocytopenia"),
    ("neonatal intensive care", "neonatal intensive care unit", "nicu", "scbu", "special care baby unit"),
    ("antibiotic stewardship", "antimicrobial stewardship", "stewardship"),
    ("birth weight", "birthweight", "lbw", "low birth weight"),
)


def intent(text: Column) -> Column:
    """The intent most of whose substrings the query has; the first declared on a tie, `other` for none."""
    low = F.lower(text)
    counts = {name: count_of(low, pats) for name, pats in INTENTS.items()}
    most = F.greatest(*counts.values())
    out = F.when(most == 0, F.lit("other"))
    for name, n in counts.items():
        out = out.when(n == most, F.lit(name))
    return out


def adaptive_k(text: Column, kind: Column, base: int) -> Column:
    """More candidates for queries that compare guidelines, join several points, or ask for treatment."""
    low = F.lower(text)
    return (
        F.when(count_of(low, CROSS_TERMS) >= 2, int(base * 2.5))
        .when((count_of(low, MULTI_TERMS) >= 2) | kind.isin("risk_assessment", "monitoring"), int(base * 2))
        .when(kind == "treatment", int(base * 1.5))
        .otherwise(base)
    )


def expand(text: Column, most: int = 12) -> Column:
    """The query with up to `most` terms of the clusters it touches that it lacks, by cluster and term.

    Terms with a space or colon match as substrings, others as whole words; a
    term is lacking where it is none of the query's own tokens.
    """
    low = F.lower(text)
    seen = F.regexp_extract_all(low, F.lit("([a-z0-9:]+)"), F.lit(1))

    def touches(term: str) -> Column:
        return low.contains(term) if " " in term or ":" in term else low.rlike(r"\b" + term.replace("-", r"\-") + r"\b")

    parts = []
    for cluster in SYNONYMS:
        hit = F.lit(False)
        for t in cluster:
            hit = hit | touches(t)
        parts.append(F.when(hit, F.array(*[F.lit(t) for t in cluster])).otherwise(F.array().cast("array<string>")))
    extra = F.slice(F.filter(F.flatten(F.array(*parts)), lambda t: ~F.array_contains(seen, t)), 1, most)
    return F.when(F.size(extra) == 0, text).otherwise(F.concat(text, F.lit(" "), F.array_join(extra, " ")))


def phrases(*parts: Column) -> Column:
    """Distinct, trimmed, non-empty phrases in order, joined by a space; parts are strings or arrays of strings, null for none."""
    flat = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    clean = F.array_distinct(F.filter(F.transform(F.filter(flat, lambda x: x.isNotNull()), lambda x: F.trim(x)), lambda x: x != ""))
    return F.array_join(clean, " ")


def some(test: Column, *values: str | Column) -> Column:
    """The values where the test holds, else null."""
    return F.when(test, F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]))

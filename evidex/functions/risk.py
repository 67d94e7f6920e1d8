"""Column functions of the layered risk score and the rules around it.

Bands, points, cut-offs and wording are fixed values of the published score.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (layer, name, points, condition). Bands of one measurement exclude each other; a null measurement meets none. Fixed values.
DRIVERS = (
    (1, "Maternal High Fever", 2, "maternal_temperature >= 39.0"),
    (1, "Maternal Fever", 1, "maternal_temperature >= 38.0 AND maternal_temperature < 39.0"),
    (1, "Prolonged ROM (>24h)", 2, "rom_hours > 24"),
    (1, "ROM >= 18h", 1, "rom_hours >= 18 AND rom_hours <= 24"),
    (1, "GBS + Inadequate Abx", 1, "gbs AND NOT iap"),
    (1, "GBS + Adequate Abx", 0, "gbs AND iap"),
    (1, "Chorioamnionitis", 2, "chorio"),
    (1, "Late Preterm Baseline", 1, "ga < 37.0"),
    (2, "Severe Resp. Distress", 2, "respiratory = 'Severe'"),
    (2, "Mild Resp. Distress", 1, "respiratory = 'Mild'"),
    (2, "CPAP/Ventilation", 2, "oxygen = 'CPAP/Ventilation'"),
    (2, "Supplemental Oxygen", 1, "oxygen = 'Supplemental'"),
    (2, "Low APGAR (<4)", 2, "apgar < 4"),
    (2, "Mod. APGAR (4-6)", 1, "apgar >= 4 AND apgar <= 6"),
    (2, "Poor Perfusion", 1, "poor_perfusion"),
    (2, "Hypothermia", 1, "neonatal_temperature < 36.5"),
    (2, "Hyperthermia", 1, "neonatal_temperature > 37.5"),
    (2, "Neonatal Seizures", 2, "neuro = 'Seizures'"),
    (2, "Lethargy/Irritability", 1, "neuro = 'Irritable/Lethargic'"),
    (3, "Abnormal WBC", 1, "wbc < 5000 OR wbc > 25000"),
    (3, "Elevated I:T Ratio", 1, "it_ratio >= 0.20"),
    (3, "Thrombocytopenia", 1, "platelets < 100000"),
    (3, "Severely High CRP", 2, "crp >= 30.0"),
    (3, "Elevated CRP", 1, "crp >= 10.0 AND crp < 30.0"),
    (3, "Elevated PCT", 1, "pct >= 0.5"),
    (3, "Positive Blood Culture", 3, "culture"),
)
#: Terms of the logit and their conditions; fixed values.
LOGIT = (
    ("ga < 37", 0.8),
    ("maternal_temperature >= 38.0", 0.6),
    ("maternal_temperature >= 39.0", 0.4),
    ("rom_hours >= 18", 0.5),
    ("rom_hours >= 24", 0.3),
    ("gbs AND NOT iap", 0.7),
    ("chorio", 1.2),
    ("iap", -0.5),
)
#: Combination notes in order: (name, condition on concern levels 0 to 2).
NOTES = (
    ("maternal risk alone", "c1 = 2 AND c2 = 0 AND c3 = 0"),
    ("concordant evidence", "c1 >= 1 AND c2 >= 1 AND c3 >= 1"),
    ("override of reassuring history", "c1 = 0 AND (c2 = 2 OR c3 = 2)"),
)
CATEGORIES = ("CRITICAL", "HIGH", "INTERMEDIATE", "LOW")


def drivers() -> Column:
    """Array of (layer, name, points) that apply to the row."""
    one = lambda layer, name, points, test: F.when(F.expr(test), F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("name"), F.lit(points).alias("points")))
    return F.array_compact(F.array(*[one(*d) for d in DRIVERS]))


def layer_sum(array: Column, layer: int) -> Column:
    """Points of a layer."""
    return F.aggregate(F.filter(array, lambda d: d["layer"] == layer), F.lit(0), lambda a, d: a + d["points"])


def total_score(l1: Column, l2: Column, l3: Column, culture: Column) -> Column:
    """Sum of layers; a positive culture makes it ten at least."""
    total = l1 + l2 + l3
    return F.when(F.coalesce(culture, F.lit(False)), F.greatest(total, F.lit(10))).otherwise(total)


def category(total: Column) -> Column:
    """Ten and over is critical, seven high, four intermediate, else low."""
    return F.when(total >= 10, "CRITICAL").when(total >= 7, "HIGH").when(total >= 4, "INTERMEDIATE").otherwise("LOW")


def concern(score: Column) -> Column:
    """2 from five points, 1 from two, else 0."""
    return F.when(score >= 5, 2).when(score >= 2, 1).otherwise(0)


def probability(l2: Column, l3: Column) -> Column:
    """Cases per 1000: logistic of the maternal terms, held in [0.1, 50], scaled by the other layers."""
    z = sum((F.when(F.expr(test), w).otherwise(0.0) for test, w in LOGIT), F.lit(-7.0))
    base = F.least(F.lit(50.0), F.greatest(F.lit(0.1), 1000 / (1 + F.exp(-z))))
    return F.round(base * (1.0 + l2 * 0.15 + l3 * 0.25), 2)


def combination_note() -> Column:
    """First note whose condition on c1, c2, c3 holds, or null."""
    out = None
    for name, test in NOTES:
        out = F.when(F.expr(test), name) if out is None else out.when(F.expr(test), name)
    return out


def shares(array: Column, total: Column) -> Column:
    """Drivers with their percentage of the total; 0 where that is 0."""
    return F.transform(array, lambda d: F.struct(d["name"].alias("name"), F.when(total == 0, 0.0).otherwise(F.round(d["points"] * 100.0 / F.greatest(total, F.lit(1)), 4)).alias("percent")))


def warnings() -> Column:
    """Scope, late preterm and culture warnings that apply."""
    return F.array_compact(F.array(F.when(F.expr("ga < 35"), "below scope"), F.when(F.expr("ga >= 35 AND ga < 37"), "late preterm"), F.when(F.expr("culture"), "positive culture")))


#: Regimen words, first-line pairs and placeholders; fixed values.
PAIRS = {"gentamicin": ("benzylpenicillin", "ampicillin", "penicillin"), "benzylpenicillin": ("gentamicin",), "ampicillin": ("gentamicin",)}
DOSE = r"[0-9]+(?:\.[0-9]+)?\s*mg/kg(?:/dose)?|\bevery\s+[0-9]+\s*hours?\b|\bonce\s+(?:a\s+)?daily\b"
PLACEHOLDERS = ("no specific antibiotic regimen", "regimen not provided", "not provided in", "no antibiotic regimen", "regimen not available")
DRUG_WORDS = ("gentamicin", "ampicillin", "benzylpenicillin", "penicillin", "clindamycin", "cefotaxime")
AMINOGLYCOSIDES = ("gentamicin", "gentamycin")
BETA_LACTAMS = ("penicillin", "ampicillin", "benzylpenicillin", "amoxicillin")
SEVERITY = {1: "HIGH", 2: "CRITICAL", 3: "CRITICAL"}
ACTIONS = {
    "LOW": ("Routine observation", "Monitor vital signs per unit protocol"),
    "INTERMEDIATE": ("Enhanced monitoring every 4 hours", "Consider baseline blood culture and CRP", "Senior review if clinical deterioration"),
    "HIGH": ("Blood culture before antibiotics if possible", "Empirical IV antibiotics per active guideline", "Senior neonatologist review"),
    "CRITICAL": ("Immediate IV antibiotics — do not delay for cultures", "NICU admission and full sepsis workup", "Supportive care for perfusion and ventilation"),
}


def actions(cat: Column) -> Column:
    """Actions of the first level whose name the category contains; intermediate ones for none."""
    key = F.upper(cat)
    out = None
    for name, items in ACTIONS.items():
        value = F.array(*[F.lit(x) for x in items])
        out = F.when(key.contains(name), value) if out is None else out.when(key.contains(name), value)
    return out.otherwise(F.array(*[F.lit(x) for x in ACTIONS["INTERMEDIATE"]]))


def contraindications(drugs: Column, stage: Column, urine: Column, creatinine: Column, allergy: Column) -> Column:
    """Flags (drug, severity, rule) of proposed drugs, in their order.

    An aminoglycoside is flagged by kidney-injury stage, or by one reading of
    urine under 0.5 or creatinine over 1.5; a beta-lactam by a documented
    allergy.
    """
    low = F.transform(drugs, lambda d: F.lower(F.trim(d)))
    has = lambda d, names: F.greatest(*[d.contains(n).cast("int") for n in names]) == 1
    flag = lambda d, s, r: F.struct(d.alias("drug"), s.alias("severity"), F.lit(r).alias("rule"))
    single = (F.coalesce(urine < 0.5, F.lit(False))) | (F.coalesce(creatinine > 1.5, F.lit(False)))
    severity = F.when(stage >= 2, "CRITICAL").otherwise("HIGH")

    def of(d: Column) -> Column:
        kidney = F.when(has(d, AMINOGLYCOSIDES) & (F.coalesce(stage, F.lit(0)) >= 1), flag(d, severity, "kidney stage")).when(has(d, AMINOGLYCOSIDES) & single, flag(d, F.lit("HIGH"), "single reading"))
        lactam = F.when(has(d, BETA_LACTAMS) & F.coalesce(allergy, F.lit(False)), flag(d, F.lit("CRITICAL"), "allergy"))
        return F.array_compact(F.array(kidney, lactam))

    return F.flatten(F.transform(low, of))


def outpatient_exclusions(setting: Column, weight: Column, recent: Column) -> Column:
    """Reasons against outpatient care without referral: weight under 1500 g, in hospital within 14 days."""
    both = F.array_compact(F.array(F.when(weight < 1500, "birth weight"), F.when(recent, "recent hospital stay")))
    return F.when(setting == "outpatient_no_referral", both).otherwise(F.array().cast("array<string>"))


def trend_note(delta: Column) -> Column:
    """Direction of a score change of two or more, else empty."""
    return F.when(delta >= 2, "deteriorating").when(delta <= -2, "improving").otherwise("")


def blob(regimen: Column) -> Column:
    return F.lower(F.array_join(F.coalesce(regimen, F.array().cast("array<string>")), " || "))


def regimen_missing(regimen: Column) -> Column:
    """Empty, or a placeholder phrase without any drug word."""
    b = blob(regimen)
    placeholder = sum((b.contains(p).cast("int") for p in PLACEHOLDERS), F.lit(0)) > 0
    drug = sum((b.contains(p).cast("int") for p in DRUG_WORDS), F.lit(0)) > 0
    return (F.coalesce(F.size(regimen), F.lit(0)) <= 0) | (placeholder & ~drug)


def regimen_incomplete(required: Column, regimen: Column, contraindication: Column) -> Column:
    """A first-line drug without any partner, unless kidney injury explains it."""
    b = blob(regimen)
    present = sum((b.contains(d).cast("int") for d in PAIRS), F.lit(0)) > 0
    paired = F.lit(False)
    for drug, partners in PAIRS.items():
        for p in partners:
            paired = paired | (b.contains(drug) & b.contains(p))
    return required & present & ~paired & (F.coalesce(contraindication, F.lit("")) != "gentamicin_aki")


def dose_tokens(entry: Column) -> Column:
    """Dose and frequency tokens of a regimen entry."""
    return F.regexp_extract_all(entry, F.lit(f"(?i)({DOSE})"), F.lit(1))


def ungrounded(regimen: Column, evidence: Column) -> Column:
    """Dose tokens of the regimen that the evidence (lower case, single spaces) lacks."""
    toks = F.flatten(F.transform(regimen, dose_tokens))
    norm = lambda t: F.lower(F.regexp_replace(F.trim(t), r"\s+", " "))
    return F.filter(toks, lambda t: ~evidence.contains(norm(t)))


def strip_doses(regimen: Column, evidence: Column, marker: str = "[dose/frequency not specified in retrieved evidence]") -> Column:
    """Entries with each ungrounded token replaced by a marker."""
    norm = lambda t: F.lower(F.regexp_replace(F.trim(t), r"\s+", " "))
    return F.transform(regimen, lambda e: F.aggregate(F.filter(dose_tokens(e), lambda t: ~evidence.contains(norm(t))), e, lambda acc, t: F.replace(acc, t, F.lit(marker))))


def overlay(flags: Column, more: Column) -> Column:
    """Flags plus those of `more` whose drug no flag before mentions; later ones see earlier ones."""
    drug = lambda f: F.lower(F.trim(F.regexp_extract(f, r"^\s*\[\w+\]\s*([^:]+):", 1)))
    return F.aggregate(
        more, flags, lambda acc, f: F.when((drug(f) != "") & F.lower(F.array_join(acc, " || ")).contains(drug(f)), acc).otherwise(F.concat(acc, F.array(f)))
    )


def safety_net(required: Column, regimen: Column, guideline: Column, contraindication: Column) -> Column:
    """Regimen with its gaps filled by marked defaults.

    A missing regimen becomes the guideline's pair, with clindamycin in place
    of the beta-lactam under allergy; a lone first-line drug gets its partner;
    allergy without clindamycin gets it; benzylpenicillin becomes ampicillin
    under WHO.
    """
    mark = "[DETERMINISTIC DEFAULT] IV "
    beta = F.when(guideline == "NICE", "benzylpenicillin").when(guideline.isin("WHO", "AAP"), "ampicillin").otherwise("benzylpenicillin")
    one = F.concat(F.lit(mark), beta)
    gent, clinda = F.lit(mark + "gentamicin"), F.lit(mark + "clindamycin")
    allergy = F.coalesce(contraindication, F.lit("")) == "penicillin_allergy"
    full = F.when(allergy, F.array(clinda, gent)).otherwise(F.array(one, gent))
    b = blob(regimen)
    partner = F.when(b.contains("gentamicin"), one).otherwise(gent)
    none = F.array().cast("array<string>")
    more = F.when(regimen_incomplete(required, regimen, contraindication), F.array(partner)).otherwise(none)
    second = F.concat(regimen, more)
    third = F.when(allergy & ~blob(second).contains("clindamycin"), F.concat(second, F.array(clinda))).otherwise(second)
    filled = F.when(regimen_missing(regimen), full).otherwise(third)
    fixed = F.transform(filled, lambda e: F.when((guideline == "WHO") & ~F.lower(e).contains("ampicillin"), F.regexp_replace(e, r"(?i)\bbenzylpenicillin(?:\s+sodium)?\b", "ampicillin")).otherwise(e))
    return F.when(required, fixed).otherwise(regimen)


#: Sources that count as the guideline's own; any other guideline's own source is its name. Fixed values.
OWN_SOURCES = {"NICE": ("NICE",), "WHO": ("WHO",), "AAP": ("AAP",)}


def guideline_match(active: Column, source: Column) -> Column:
    """Whether a source belongs to the active guideline: by exact name, never as a part of one."""
    a, s = F.upper(F.coalesce(active, F.lit(""))), F.upper(F.trim(F.coalesce(source, F.lit(""))))
    listed = F.lit(False)
    for name, own in OWN_SOURCES.items():
        listed = listed | ((a == name) & s.isin(*own))
    return listed | (~a.isin(*OWN_SOURCES) & (a == s))


def guideline_conflict(sources: Column, active: Column) -> Column:
    """Whether two or more distinct named sources are outside the active guideline."""
    named = F.transform(sources, lambda x: F.upper(F.trim(F.coalesce(x, F.lit("")))))
    off = F.filter(F.array_distinct(named), lambda x: (x != "") & ~guideline_match(active, x))
    return F.size(off) >= 2

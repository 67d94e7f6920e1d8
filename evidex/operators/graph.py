"""Property graph of guidelines as node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import has_any, words_at_least
from evidex.operators.fusion import tier_of_text, tier_score
from evidex.operators.retrieval import top_k
from evidex.sources.tables import spread, stored

#: Edge types that a graph may hold; fixed values.
EDGE_TYPES = ("RECOMMENDS", "TREATS", "HAS_RISK_FACTOR", "HAS_SYMPTOM", "REQUIRES", "STOP_IF", "MONITOR_WITH", "CONTRAINDICATED_IN", "HAS_DOSE", "SUPPORTED_BY", "ACTIVE_AGAINST", "PRESCRIBES")
#: Surface forms and the entities that they name; fixed values.
SURFACE = {
    "maternal gbs colonization": "MaternalGBSColonization",
    "gbs colonization": "MaternalGBSColonization",
    "gbs positive": "MaternalGBSColonization",
    "group b strep": "GroupBStreptococcus",
    "gbs": "GroupBStreptococcus",
    "prolonged rupture of membranes": "ProlongedROM",
    "rupture of membranes": "ProlongedROM",
    "rom ": "ProlongedROM",
    "maternal intrapartum fever": "MaternalFever",
    "maternal fever": "MaternalFever",
    "intrapartum fever": "MaternalFever",
    "clinical chorioamnionitis": "ClinicalChorioamnionitis",
    "chorioamnionitis": "Chorioamnionitis",
    "respiratory distress": "RespiratoryDistress",
    "poor perfusion": "PoorPerfusion",
    "hypotension": "Hypotension",
    "elevated crp": "CRP",
    "crp": "CRP",
    "positive blood culture": "BloodCulture",
    "blood culture": "BloodCulture",
    "temperature instability": "TemperatureInstability",
    "lethargy": "Lethargy",
    "apnoea": "Apnea",
    "apnea": "Apnea",
    "seizure": "Seizures",
    "tachycardia": "Tachycardia",
    "prematurity": "Prematurity",
    "preterm": "Prematurity",
    "inadequate intrapartum antibiotics": "InadequateIntrapartumAntibiotics",
    "penicillin allerg": "Benzylpenicillin",
    "gentamicin": "Gentamicin",
    "benzylpenicillin": "Benzylpenicillin",
    "ampicillin": "Ampicillin",
    "meningitis": "Meningitis",
    "listeria": "ListeriaMonocytogenes",
    "creatinine": "Creatinine",
    "urine output": "UrineOutput",
    "lumbar puncture": "LumbarPuncture",
    "platelet": "PlateletCount",
}
#: Words that point to a kind of section; fixed values.
SECTION_WORDS = {
    "Contraindications": ("contraindicat", "caution", "avoid", "should not be used", "allerg"),
    "Duration": ("duration", "how long", "course length", "days of treatment"),
    "Monitoring": ("monitor", "levels", "trough", "peak concentration"),
    "AlternativeAntibiotics": ("alternative", "second-line", "second line"),
    "LaboratoryInvestigations": ("laboratory", "lab test", "investigation", "blood test"),
    "StoppingCriteria": ("stop", "discontinue", "cease"),
    "Diagnosis": ("diagnos", "diagnostic", "imci", "possible serious bacterial infection", "psbi", "danger sign"),
    "WhenToStartAntibiotics": ("when to start", "initiate", "start antibiotic", "critical", "high", "intermediate"),
    "FirstLineAntibiotics": ("first-line", "first line", "empirical", "regimen"),
    "RiskFactors": ("risk factor",),
    "ClinicalSigns": ("clinical sign", "symptom"),
    "SpecialSituations": ("special situation", "exception", "deteriorat", "improv"),
    "ParentCommunication": ("parent", "carer", "famil", "communicat", "inform", "discuss", "counsel", "handover", "discharge", "transfer"),
    "NutritionFluid": ("feed", "breastfe", "nutrition", "fluid", "enteral", "parenteral", "maintenance fluid"),
}


def unique_section_ids(sections: DataFrame) -> DataFrame:
    """Repeated section ids within a guideline get `_b`, `_c`, ... in order of type; `old_id` keeps the first form."""
    w = Window.partitionBy("guideline", "section_id").orderBy("section_type")
    n = F.row_number().over(w)
    suffix = F.when(n == 1, "").otherwise(F.concat(F.lit("_"), F.char(F.lit(96) + n)))
    return sections.withColumn("_new", F.concat("section_id", suffix)).withColumnRenamed("section_id", "old_id").withColumnRenamed("_new", "section_id")


def remap_targets(edges: DataFrame, sections: DataFrame, types: DataFrame, relationship: str = "SUPPORTED_BY") -> DataFrame:
    """Edges of one relationship lead to the renamed section of their origin's type; others, and those without such a section, stay.

    sections (old_id, section_type, section_id) as `unique_section_ids` gives
    them for one guideline; types (id, section_type), one row an origin.
    """
    t = types.select(F.col("id").alias("from_id"), F.col("section_type").alias("_type"))
    s = sections.select(F.col("old_id").alias("to_id"), F.col("section_type").alias("_type"), F.col("section_id").alias("_new")).distinct()
    mine = F.col("relationship") == relationship
    moved = edges.where(mine).join(t, "from_id", "left").join(s, ["to_id", "_type"], "left").select("from_id", "relationship", F.coalesce("_new", "to_id").alias("to_id"))
    return edges.where(~F.coalesce(mine, F.lit(False))).select("from_id", "relationship", "to_id").unionByName(moved)


def repair_edges(edges: DataFrame, doses: DataFrame, roots: DataFrame) -> DataFrame:
    """RECOMMENDS edges that lead to a dose become PRESCRIBES; missing root edges (from_id, to_id) are added."""
    d = doses.select(F.col("id").alias("to_id"), F.lit(True).alias("_dose"))
    fixed = edges.join(d, "to_id", "left").withColumn("relationship", F.when((F.col("relationship") == "RECOMMENDS") & F.col("_dose"), "PRESCRIBES").otherwise(F.col("relationship")))
    fixed = fixed.select("from_id", "relationship", "to_id")
    missing = roots.join(fixed.where("relationship = 'RECOMMENDS'"), ["from_id", "to_id"], "left_anti").select("from_id", F.lit("RECOMMENDS").alias("relationship"), "to_id")
    return fixed.unionByName(missing)


def derived_doses(edges: DataFrame, doses: DataFrame) -> DataFrame:
    """HAS_DOSE edges of (drug, dose) that the graph lacks."""
    new = doses.select(F.col("drug").alias("from_id"), F.lit("HAS_DOSE").alias("relationship"), F.col("dose").alias("to_id")).distinct()
    return new.join(edges, ["from_id", "relationship", "to_id"], "left_anti")


def build(edges: DataFrame) -> DataFrame:
    """Edges of the allowed types."""
    return edges.where(F.col("relationship").isin(*EDGE_TYPES))


def unreachable_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots (id) without a RECOMMENDS edge."""
    return nodes.join(edges.where("relationship = 'RECOMMENDS'").select(F.col("from_id").alias("id")), "id", "left_anti")


#: Edges of a node above which they are dealt to several tasks.
HUB_EDGES = 1 << 16


@dataclass(frozen=True)
class Step:
    """One step of a path: over edges of a relationship (None: any), against their direction if `back`, to nodes of a kind (None: any)."""

    relationship: str | None = None
    back: bool = False
    kind: str | None = None


def step(reached: DataFrame, edges: DataFrame, nodes: DataFrame, how: Step) -> DataFrame:
    """(id, entity) after one step from `reached` (id, entity), without repeats; the edges of a hub are dealt to several tasks."""
    used = edges.where(F.col("relationship") == how.relationship) if how.relationship else edges
    here, there = ("to_id", "from_id") if how.back else ("from_id", "to_id")
    used = used.select(F.col(here).alias("entity"), F.col(there).alias("_next")).where("entity is not null and _next is not null").distinct()
    if how.kind is not None:
        used = used.join(nodes.where(F.col("kind") == how.kind).select(F.col("node").alias("_next")).distinct(), "_next", "left_semi")
    hubs = used.groupBy("entity").agg(F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("_parts")).where("_parts > 1")
    dealt = used.join(hubs, "entity", "left").withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.hash("_next"), F.col("_parts"))).otherwise(0))
    asking = reached.join(hubs, "entity", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return asking.select("id", "entity", "_part").join(dealt.select("entity", "_part", "_next"), ["entity", "_part"]).select("id", F.col("_next").alias("entity")).distinct()


def follow(edges: DataFrame, nodes: DataFrame, start: DataFrame, paths: list[tuple[Step, ...]]) -> DataFrame:
    """(id, entity): the nodes at which any of `paths` ends, for each start id; no repeats.

    edges (from_id, relationship, to_id), nodes (node, kind), start (id). A
    beginning that several paths share is walked once and written between steps.
    """
    walked: dict[tuple[Step, ...], DataFrame] = {(): start.select("id", F.col("id").alias("entity")).distinct()}
    shared = {p[:n] for p in paths for n in range(1, len(p))}
    for path in sorted(set(paths) | shared, key=len):
        found = step(walked[path[:-1]], edges, nodes, path[-1])
        walked[path] = stored(found) if path in shared else found
    return reduce(DataFrame.unionByName, [walked[p] for p in dict.fromkeys(paths)]).distinct()


def recommendation_entities(edges: DataFrame, nodes: DataFrame, start: DataFrame, dose: str = "Dose", relationship: str = "HAS_DOSE") -> DataFrame:
    """(id, entity): what a recommendation leads to; for a dose also the drugs that have it, and what these lead to."""
    to_dose, drug = Step(kind=dose), Step(relationship, back=True)
    return follow(edges, nodes, start, [(Step(),), (to_dose, drug), (to_dose, drug, Step())])


def named(text: Column, dictionary: dict) -> Column:
    """Sorted distinct names whose form or words the text (any case) contains."""
    low = F.lower(text)
    hits = [F.when(has_any(low, (k,) if isinstance(v, str) else v), F.lit(v if isinstance(v, str) else k)) for k, v in dictionary.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def calibrate(recs: DataFrame, chunks: DataFrame, reach: int = 15, least: int = 3) -> DataFrame:
    """Page shift of each source that gives recommendations the most words on their pages.

    recs (rec_id, guideline_id, text_summary, page) against chunks (source,
    page, chunk_text) for shifts of -reach to reach; the smallest shift on a
    tie. Words of a page are joined on (source, page, word), so no page is
    held against every recommendation. Returns source, shift, total and hits
    (recommendations with `least` words or more).
    """
    wanted = recs.select("rec_id", F.col("guideline_id").alias("source"), "page", F.explode(words_at_least("text_summary", 5, True)).alias("w"))
    wanted = wanted.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("page", F.col("page") - F.col("shift"))
    words = chunks.select("source", "page", F.explode(words_at_least("chunk_text", 5, True)).alias("w")).distinct()
    n = wanted.join(words, ["source", "page", "w"]).groupBy("source", "shift", "rec_id").agg(F.count("*").alias("n"))
    by = n.groupBy("source", "shift").agg(F.sum("n").alias("total"), F.sum((F.col("n") >= least).cast("long")).alias("hits"))
    w = Window.partitionBy("source").orderBy(F.col("total").desc(), "shift")
    return by.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def heads(recs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The posting tables of recommendations: heads, and words under heads.

    A head is what recommendations share but for their words: an entity (or
    none), the kind of their section and their tier. Heads (head, entity, kind,
    tier, first) hold the k smallest ids; words (head, w, rec_id) all.
    """
    summary = F.coalesce("text_summary", F.lit(""))
    r = recs.select("rec_id", F.col("section_type").alias("kind"), words_at_least("text_summary", 4, True).alias("rw"), named(summary, SURFACE).alias("re"), tier_of_text(summary).alias("tier"))
    r = r.withColumn("entity", F.explode(F.concat(F.array(F.lit("")), "re"))).withColumn("head", F.to_json(F.struct("entity", "kind", "tier"))).drop("re")
    w = Window.partitionBy("head").orderBy("rec_id")
    first = r.drop("rw").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    first = first.groupBy("head").agg(*(F.first(c).alias(c) for c in ("entity", "kind", "tier")), F.array_sort(F.collect_list("rec_id")).alias("first"))
    return stored(first), r.select("head", F.explode("rw").alias("w"), "rec_id")


#: Queries of a block that is held against all recommendations.
BLOCK = 1_024


def all_candidates(queries: DataFrame, recs: DataFrame, baseline_kinds: tuple[str, ...]) -> DataFrame:
    """(qid, rec_id, section_type, baseline, score): every recommendation that matches a query or is baseline, scored as in `candidates`.

    Queries are held in blocks of about `BLOCK` against the recommendations
    where these lie; no pair is shuffled.
    """
    text, summary = F.coalesce("text", F.lit("")), F.coalesce("text_summary", F.lit(""))
    q = stored(queries.select("qid", words_at_least("text", 4, True).alias("qw"), named(text, SURFACE).alias("qe"), named(text, SECTION_WORDS).alias("qs"), tier_of_text(text).alias("qt")))
    r = stored(recs.select("rec_id", "section_type", words_at_least("text_summary", 4, True).alias("rw"), named(summary, SURFACE).alias("re"), tier_of_text(summary).alias("rt")))
    r = spread(r, "rec_id")
    blocks = max(1, -(-q.count() // BLOCK))
    entity, section = F.arrays_overlap("qe", "re"), F.coalesce(F.array_contains("qs", F.col("section_type")), F.lit(False))
    baseline = F.coalesce(F.col("section_type").isin(*baseline_kinds), F.lit(False))
    points = 100 * entity.cast("int") + 10 * section.cast("int") + F.when(baseline & ~entity & ~section, 5).otherwise(0)
    score = points + F.size(F.array_intersect("qw", "rw")) + 20 * tier_score(F.col("qt"), F.col("rt"))
    parts = []
    for b in range(blocks):
        met = r.join(F.broadcast(q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)), entity | section | baseline)
        parts.append(met.select("qid", "rec_id", "section_type", baseline.alias("baseline"), score.cast("double").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def candidates(queries: DataFrame, recs: DataFrame, baseline_kinds: tuple[str, ...], k: int = 10) -> DataFrame:
    """(qid, rec_id, section_type, baseline, score): the k best recommendations of each query and kind of section.

    Those that match a query or are baseline score 100 points where both name an
    entity, 10 where the query points to the section's kind, 5 for a baseline
    section without either, one for each shared word of four letters, and 20 for
    the same severity tier (-20 for the other); ties by id. queries (qid
    unique, text), recs (rec_id unique, section_type, text_summary); null texts
    have no words and no names.

    All but the words is the same for all recommendations under a head, so a
    query has its points for whole heads, and its k-th best of their first ids
    bounds its k-th best score from below. Only heads that can reach this with
    all of the query's words are joined word by word.
    """
    text = F.coalesce("text", F.lit(""))
    q = stored(queries.select("qid", words_at_least("text", 4, True).alias("qw"), named(text, SURFACE).alias("qe"), named(text, SECTION_WORDS).alias("qs"), tier_of_text(text).alias("qt")))
    head, words = heads(recs, k)
    by_entity = q.select("*", F.explode("qe").alias("entity")).join(head.where("entity <> ''"), "entity")
    wanted = F.array_union("qs", F.array(*(F.lit(x) for x in baseline_kinds)).cast("array<string>"))
    by_kind = q.select("*", F.explode(wanted).alias("kind")).join(head.where("entity = ''"), "kind")
    section = F.coalesce(F.array_contains("qs", F.col("kind")), F.lit(False))
    points = F.when(F.col("entity") != "", 100 + 10 * section.cast("int")).otherwise(F.when(section, 10).otherwise(5)) + 20 * tier_score(F.col("qt"), F.col("tier"))
    cols = ["qid", "head", "kind", "first", "qw", points.alias("points")]
    asked = stored(by_entity.select(*cols).unionByName(by_kind.select(*cols)))

    known = asked.select("qid", "kind", "points", F.explode("first").alias("rec_id")).groupBy("qid", "kind", "rec_id").agg(F.max("points").alias("score"))
    floor = top_k(known, k, by=("qid", "kind"), tie="rec_id").groupBy("qid", "kind").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    able = asked.join(floor.withColumnRenamed("qid", "_q").withColumnRenamed("kind", "_k"), (F.col("qid") == F.col("_q")) & F.col("kind").eqNullSafe(F.col("_k")))
    able = able.where(F.col("floor").isNull() | (F.col("points") + F.size("qw") >= F.col("floor")))
    shared = able.select("qid", "kind", "head", "points", F.explode("qw").alias("w")).join(words, ["head", "w"])
    shared = shared.groupBy("qid", "kind", "rec_id", "head").agg((F.max("points") + F.count("*")).alias("score")).drop("head")
    scored = known.unionByName(shared).groupBy("qid", "kind", "rec_id").agg(F.max("score").cast("double").alias("score"))
    best = top_k(scored, k, by=("qid", "kind"), tie="rec_id")
    return best.select("qid", "rec_id", F.col("kind").alias("section_type"), F.coalesce(F.col("kind").isin(*baseline_kinds), F.lit(False)).alias("baseline"), "score")


def page_window(recs: DataFrame, chunks: DataFrame, reach: int = 5) -> DataFrame:
    """Chunks within `reach` pages of each recommendation (its page already shifted), best first.

    A chunk has three points for each word that it shares with the
    recommendation's summary and one for each that it shares with the query.
    recs (qid, rec_id, guideline_id, page, text_summary, text), one row for each
    query and recommendation. Pages fall into buckets as wide as the window, so
    the range join is an equi-join on three neighbouring buckets; chunks of
    other buckets are left out before their words are taken or shuffled.
    """
    width = 2 * reach + 1
    bucket = lambda c: F.floor(F.col(c) / width)
    r = recs.select("qid", "rec_id", F.col("guideline_id").alias("source"), F.col("page").alias("rec_page"), words_at_least("text_summary", 4, True).alias("hint"), words_at_least("text", 4, True).alias("asked"))
    r = stored(r.withColumn("bucket", F.explode(F.sequence(bucket("rec_page") - 1, bucket("rec_page") + 1))))
    c = chunks.withColumn("bucket", bucket("page")).join(r.select("source", "bucket").distinct(), ["source", "bucket"], "left_semi")
    c = c.select("chunk_id", "source", "page", "bucket", words_at_least("chunk_text", 4, True).alias("words"))
    near = r.join(c, ["source", "bucket"]).where(F.abs(F.col("page") - F.col("rec_page")) <= reach)
    scored = near.withColumn("score", 3 * F.size(F.array_intersect("hint", "words")) + F.size(F.array_intersect("asked", "words")))
    w = Window.partitionBy("qid", "rec_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).select("qid", "rec_id", "chunk_id", "score", "rank")


def route(guideline: Column, age_weeks: Column, limit: float = 35.0) -> Column:
    """Subgraph of a guideline; AAP below `limit` weeks goes to its preterm variant."""
    return F.when((guideline == "AAP") & (age_weeks < limit), "AAP_PRETERM").when(guideline == "AAP", "AAP_TERM").otherwise(guideline)


def select_covering(candidates: DataFrame, k: int, rounds: int = 2, per_rec: int = 2) -> DataFrame:
    """Bounded choice per query: `rounds` rounds give each baseline kind one new chunk, then the best scores fill up.

    candidates (qid, rec_id, kind, baseline, score, chunk_id, rank): at most
    `per_rec` chunks of a recommendation, no chunk twice, scores over 120 and
    held to 1.
    """
    import pandas as pd

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "rec_id", "rank", "chunk_id"], ascending=[False, True, True, True]).to_dict("records")
        taken, used, out = set(), {}, []

        def take(r) -> bool:
            if len(out) >= k or r["chunk_id"] in taken or used.get(r["rec_id"], 0) >= per_rec:
                return False
            taken.add(r["chunk_id"])
            used[r["rec_id"]] = used.get(r["rec_id"], 0) + 1
            out.append(r)
            return True

        kinds = sorted({r["kind"] for r in rows if r["baseline"]})
        for _ in range(rounds):
            for kind in kinds:
                next((1 for r in rows if r["baseline"] and r["kind"] == kind and take(r)), None)
        for r in rows:
            take(r)
        return pd.DataFrame([(r["qid"], r["chunk_id"], min(1.0, r["score"] / 120), i) for i, r in enumerate(out, 1)], columns=["qid", "chunk_id", "score", "rank"])

    kind = candidates.schema["qid"].dataType.simpleString()
    return candidates.groupBy("qid").applyInPandas(choose, f"qid {kind}, chunk_id string, score double, rank int")

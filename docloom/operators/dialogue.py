"""Conversation history, question features and routing, and evaluation of answers and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lexicon
from docloom.functions.text import contains_any, tokens


def history_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the assistant turn right after it, if any."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    told = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("_role"), F.lead("text").over(w).alias("_text"))
    return told.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("_role") == "assistant", F.col("_text")).alias("answer"))


def last_turns(turns: DataFrame, n: int = 8) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def history_rows(pairs: DataFrame) -> DataFrame:
    """Two rows, user and assistant, of each answered pair, with vectors (question_vector, answer_vector) as JSON."""
    rows = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.to_json("question_vector").alias("embedding")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.to_json("answer_vector").alias("embedding")),
    )
    return pairs.select("conversation_id", "timestamp", F.explode(rows).alias("r")).select("conversation_id", "r.*", "timestamp")


def pattern_count(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns match, each once."""
    return sum((text.rlike(f"(?iu){p}").cast("int") for p in patterns), F.lit(0))


def question_features(text: Column) -> dict[str, Column]:
    """The numbers that routing looks at."""
    low = F.lower(text)
    rag, llm = pattern_count(text, lexicon.RAG_PATTERNS), pattern_count(text, lexicon.LLM_PATTERNS)
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    flags = {
        "has_question_mark": marks > 0,
        "has_imperative": contains_any(low, lexicon.IMPERATIVES),
        "has_modal": contains_any(low, lexicon.MODALS),
        "has_multiple_questions": marks > 1,
        "has_comparative": contains_any(low, lexicon.COMPARATIVES),
        "is_how_to": F.contains(low, F.lit("comment")),
        "is_what_is": contains_any(low, lexicon.WHAT_IS),
        "is_request": contains_any(low, lexicon.REQUESTS),
    }
    out = {"length": F.length(text), "word_count": F.size(tokens(text))} | {k: v.cast("int") for k, v in flags.items()}
    return out | {"llm_pattern_count": llm, "rag_pattern_count": rag, "pattern_ratio": F.round(llm / F.greatest(rag, F.lit(1)), 6)}


def route(rag: Column, llm: Column) -> tuple[Column, Column]:
    """(route, confidence) by pattern counts: clear cases at 0.9, else the share of the larger count, and the model alone below 0.52."""
    share = F.greatest(rag, llm) / F.greatest(rag + llm, F.lit(1))
    mode = F.when((rag >= 2) & (llm == 0), "rag").when((llm >= 2) & (rag == 0), "llm").when((rag > llm) & (share >= 0.52), "rag").otherwise("llm")
    sure = F.when(((rag >= 2) & (llm == 0)) | ((llm >= 2) & (rag == 0)), 0.9).otherwise(F.round(share, 6))
    return mode, sure


def hybrid_label(label: Column, rag: Column, llm: Column) -> Column:
    """HYBRID becomes RAG where as many retrieval patterns match, else LLM."""
    return F.when(label != "HYBRID", label).when(rag >= llm, "RAG").otherwise("LLM")


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support), 0 where undefined, from one aggregate over (actual, predicted)."""
    cells = confusion(rows, actual, predicted)
    sides = cells.select(F.explode(F.array(F.struct(F.col(actual).alias("label"), F.lit(True).alias("is_actual")), F.struct(F.col(predicted).alias("label"), F.lit(False).alias("is_actual")))).alias("s"), (F.col(actual) == F.col(predicted)).alias("hit"), "n").select("s.*", "hit", "n")
    sums = sides.groupBy("label").agg(F.sum(F.when(F.col("hit") & F.col("is_actual"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("is_actual"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("is_actual"), F.col("n")).otherwise(0)).alias("given"))
    p, r = F.col("tp") / F.greatest("given", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    return sums.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), "support")


def confusion_scores(rows: DataFrame, pattern: str, label: str, a: str, b: str) -> DataFrame:
    """Patterns seen with both labels, by how evenly: min(a, b) / (a + b)."""
    n = rows.groupBy(pattern).agg(F.count_if(F.col(label) == a).alias("a"), F.count_if(F.col(label) == b).alias("b")).where("a > 0 and b > 0")
    return n.withColumn("score", F.round(F.least("a", "b") / (F.col("a") + F.col("b")), 6))


def mode_averages(runs: DataFrame, category: str, mode: str, value: str) -> DataFrame:
    """Counts and means by category and mode, by category, and over all (nulls stand for all)."""
    return runs.rollup(category, mode).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def fitted_router(labelled: DataFrame, text_col: str = "question", label_col: str = "label", trees: int = 100, seed: int = 42):
    """A random forest over the question features, classes weighted to balance; gives the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = with_features(labelled, text_col)
    counts = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().collect()}
    total = sum(counts.values())
    weight = F.coalesce(*(F.when(F.col(label_col) == k, F.lit(total / (len(counts) * n))) for k, n in counts.items()))
    names = list(question_features(F.col(text_col)))
    stages = [StringIndexer(inputCol=label_col, outputCol="target", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=names, outputCol="features"), RandomForestClassifier(labelCol="target", featuresCol="features", weightCol="weight", numTrees=trees, seed=seed)]
    return Pipeline(stages=stages).fit(rows.withColumn("weight", weight))


def with_features(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.withColumns(question_features(F.col(text_col)))


def corrected(text: Column, mode: Column, confidence: Column, rag: Column, llm: Column) -> Column:
    """struct(mode, confidence) after the rules that correct a route (RAG, LLM); the first that fits decides."""
    low = F.lower(text)
    has = lambda *words: contains_any(low, list(words))
    mixed = (rag >= 1) & (llm >= 1) & contains_any(low, lexicon.CREATION) & contains_any(low, lexicon.EXTRACTION)
    joined = low.rlike(r"(?U)\b(et|puis)\b")
    planned = has("liste") & has("plan", "stratégie", "mitigation") & has("pénalités", "montants")
    dated = has("échéances", "dates clés", "date butoir", "calendrier")
    compared = has("compare") & has("contrat")
    translated = (mode == "LLM") & (F.startswith(low, F.lit("traduis")) | has("comment traduire")) & has("article", "clause", "responsabilité", "obligation", "pénalité")
    told = lambda m, c: F.struct(F.lit(m).alias("mode"), F.lit(c).alias("confidence"))
    same = F.struct(mode.alias("mode"), confidence.cast("double").alias("confidence"))
    rules = [
        (mixed & contains_any(low, lexicon.STRATEGY) & ~joined, same),
        (mixed, told("RAG", 0.85)),
        (planned & has("propose", "suggère", "établis", "élabore"), told("LLM", 0.85)),
        (planned, told("RAG", 0.85)),
        (dated & (has("rappelle", "notifie", "alerte") | ~has("évalue", "analyse", "impact")), told("RAG", 0.9)),
        (compared & has("contrat a", "contrat b", "contrat c") & has("indique", "quelle"), told("RAG", 0.85)),
        (compared & has("standard", "norme", "iso", "pratique"), told("LLM", 0.9)),
        (translated & has("chiffrées", "précise"), told("RAG", 0.85)),
        ((mode == "LLM") & has("montant maximal", "garantie de bonne exécution", "puissance délivrée"), told("RAG", 0.9)),
        (has("synthèse") & has("technique") & has("liste") & has("documents"), told("RAG", 0.85)),
    ]
    return F.coalesce(*(F.when(fits, out) for fits, out in rules), same)


def similar_history(found: DataFrame, threshold: float = 0.7, n: int = 5, order: str = "pair_id") -> DataFrame:
    """Of the past pairs found for each query (query_id, similarity), those at or above the threshold, at most ``n``, most similar first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), order)
    return found.where(F.col("similarity") >= threshold).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def answered_from_history(queries: DataFrame, history: DataFrame, text_col: str = "text") -> DataFrame:
    """Queries with ``source``: history where similar pairs exist and the text does not hold ``#force``, else retrieval."""
    known = history.select("query_id").distinct().withColumn("_known", F.lit(True))
    forced = F.contains(F.col(text_col), F.lit("#force"))
    return queries.join(known, "query_id", "left").withColumn("source", F.when(F.col("_known").isNotNull() & ~forced, "history").otherwise("retrieval")).drop("_known")


def feedback_accuracy(rows: DataFrame, right: Column) -> DataFrame:
    """One row: the share of corrections that agreed, 0 without any."""
    return rows.agg(F.coalesce(F.round(F.avg(right.cast("double")), 6), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def stratified(rows: DataFrame, label_col: str, id_col: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with ``part``: of each label the ``share`` with the least hashes is test, the rest train; reruns agree."""
    w = Window.partitionBy(label_col).orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    return rows.withColumn("part", F.when(F.row_number().over(w) <= F.round(share * F.count("*").over(Window.partitionBy(label_col))), "test").otherwise("train"))


def mode_order(mode: Column) -> Column:
    """classic, graph, advanced, then the others."""
    return F.when(mode == "classic", 0).when(mode == "graph", 1).when(mode == "advanced", 2).otherwise(3)


def answer_lines(text: Column) -> Column:
    """The text less lines that begin with = or - or hold five dashes."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike("^[=-]") & ~F.contains(x, F.lit("-----"))), "\n")


def labelled_blocks(lines: DataFrame, label: Column, by: str = "doc_id") -> DataFrame:
    """Lines with the last label seen before or at them (``label``: null on other lines)."""
    w = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("label", F.last(label, ignorenulls=True).over(w))

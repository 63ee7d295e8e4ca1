"""Queries of the linear model over labelled documents: its loss and gradient at fixed weights, and classes by its scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepaudit.operators import policy, tfidf
from stepaudit.plans.views import table
from stepaudit.scratch import remove, written

#: Terms of the audited model, and its intercept; weights follow a rule.
SIZE, INTERCEPT = 500, [0.1, -0.2, 0.3]


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a class: a stand-in without meaning of its own."""
    y = table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 0, -1).when(F.col("toxic") == 1, 0).otherwise(1).alias("label"))
    return table(spark, folder, "documents").select("doc_id", "text").join(y, "doc_id")


def _known(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows = sorted(tfidf.vocabulary(docs, "text", SIZE).collect(), key=lambda r: r.term)  # at most SIZE
    w = np.sin(np.arange(len(rows))[:, None] + np.arange(3) + 1.0)
    return [r.term for r in rows], np.array([r.idf for r in rows]), w


def weight_audit(spark: SparkSession, folder: str) -> DataFrame:
    """M1, M2 and G12 without a fit: mean loss, and its gradient by term and class, at assigned weights."""
    docs = labelled(spark, folder)
    terms, idf, w = _known(docs)
    made = written(tfidf.blocks(docs, terms, idf), "blocks")
    loss, g, n = tfidf.evaluate(made, np.append(w.ravel(), INTERCEPT), len(terms))
    remove(made)
    rows = [("loss", None, None, loss), ("rows", None, None, float(n)), *[("intercept", None, c, float(x)) for c, x in zip(tfidf.CLASSES, g[-3:], strict=True)]]
    rows += [("term", t, c, float(x)) for t, own in zip(terms, g[:-3].reshape(-1, 3), strict=True) for c, x in zip(tfidf.CLASSES, own, strict=True)]
    return spark.createDataFrame(rows, "what string, term string, class int, value double").withColumn("value", F.round("value", 9))


def model_class_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the classes that the model's scores give."""
    docs = labelled(spark, folder)
    terms, idf, w = _known(docs)
    model = spark.createDataFrame([(t, float(i), *map(float, x)) for t, i, x in zip(terms, idf, w, strict=True)], tfidf.MODEL)
    got = tfidf.predict(docs.withColumn("key", F.struct("doc_id", "label")), model, INTERCEPT, "key").select("doc_id.label", "predicted")
    made = policy.class_report(got)
    return made.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def fitted_report(spark: SparkSession, folder: str) -> DataFrame:
    """M1 to M3: a model fitted on two thirds of the labelled documents, by class on the rest."""
    docs = labelled(spark, folder)
    model, b = tfidf.train(docs.where("doc_id % 3 != 0"), size=2000)
    held = docs.where("doc_id % 3 = 0").withColumn("key", F.struct("doc_id", "label"))
    return policy.class_report(tfidf.predict(held, model, b, "key").select("doc_id.label", "predicted"))


_Z = r"""d AS (SELECT d.doc_id, text, CASE WHEN quality = 0 THEN -1 WHEN toxic = 1 THEN 0 ELSE 1 END AS label FROM documents d JOIN labels USING (doc_id)),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS ws FROM d),
o AS (SELECT doc_id, unnest(ws || list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM o GROUP BY ALL),
t AS (SELECT term, sum(tf) AS cf, ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 500),
m AS (SELECT term, idf, row_number() OVER (ORDER BY term) - 1 AS k FROM t),
v AS (SELECT doc_id, term, k, (1 + ln(tf)) * idf AS v FROM tf JOIN m USING (term)),
x AS (SELECT doc_id, term, k, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM v),
s AS (SELECT doc_id, sum(v * sin(k + 1)) AS z0, sum(v * sin(k + 2)) AS z1, sum(v * sin(k + 3)) AS z2 FROM x GROUP BY doc_id),
z AS (SELECT d.doc_id, label, coalesce(z0, 0) + 0.1 AS z0, coalesce(z1, 0) - 0.2 AS z1, coalesce(z2, 0) + 0.3 AS z2 FROM d LEFT JOIN s ON s.doc_id = d.doc_id)"""

_AUDIT = f"""WITH {_Z}, p AS (SELECT doc_id, label, ln(exp(z0) + exp(z1) + exp(z2)) - CASE label WHEN -1 THEN z0 WHEN 0 THEN z1 ELSE z2 END AS loss, unnest([-1, 0, 1]) AS class,
  unnest([exp(z0), exp(z1), exp(z2)]) / (exp(z0) + exp(z1) + exp(z2)) AS p FROM z),
e AS (SELECT *, p - CASE WHEN class = label THEN 1 ELSE 0 END AS e, (SELECT count(*) FROM d) AS n FROM p)
SELECT 'loss' AS what, NULL AS term, NULL AS class, round(avg(loss), 9) AS value FROM e UNION ALL SELECT 'rows', NULL, NULL, count(*)::DOUBLE FROM d
UNION ALL SELECT 'intercept', NULL, class, round(sum(e) / any_value(n), 9) FROM e GROUP BY class
UNION ALL SELECT 'term', term, class, round(sum(e * v) / any_value(n), 9) FROM x JOIN e USING (doc_id) GROUP BY term, class"""

_REPORT = f"""WITH {_Z}, p AS (SELECT label, CASE WHEN z0 >= z1 AND z0 >= z2 THEN -1 WHEN z1 >= z2 THEN 0 ELSE 1 END AS predicted FROM z),
y AS (SELECT label AS class, true AS own, label = predicted AS hit FROM p UNION ALL SELECT predicted, false, false FROM p),
b AS (SELECT class, count(*) FILTER (own) AS support, count(*) FILTER (NOT own) AS predicted, count(*) FILTER (hit) AS hits FROM y GROUP BY class)
SELECT class, support, round(CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END, 9) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE hits / support END, 9) AS recall,
  round(CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END, 9) AS f1 FROM b"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (weight_audit, model_class_report, fitted_report)}


def oracle_sql() -> dict[str, str]:
    return {"weight_audit": _AUDIT, "model_class_report": _REPORT}

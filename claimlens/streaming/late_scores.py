"""Scores that arrive on streams of their own, late or never.

Requests, classifier answers and entailment answers are three streams.  A request waits for its two
scores until ``wait`` has passed in event time; a score that is not there by then is a failed scorer,
and the request is decided from what is left (one scorer, or none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.plans.detect import detect

WAIT = "40 seconds"
CLASSIFIER = ("label", "conf")
ENTAILMENT = ("sup", "con", "nli_decision", "any_contra", "any_unsupp")


def with_scores_in_time(requests: DataFrame, answers: DataFrame, columns: tuple[str, ...], key: str = "event_id",
                        ts: str = "ts", answered: str = "answered", wait: str = WAIT, late: str = WAIT) -> DataFrame:
    """Requests with ``columns`` of the answer that came within ``wait``, else nulls.

    A left outer join with a time bound: an answer counts if its event time lies between the
    request's and ``wait`` after it, both ends included.  On streams the state of a request ends when
    the watermark of the answers has passed its bound, and the row with nulls is sent then.  Streamed
    requests carry a watermark already; answers may be out of order by ``late``.  Null keys match nothing, and rows of
    answers without a key move no watermark.  At most one answer in time per key is
    expected: an answer repeated inside the bound repeats the request, as in a batch join.  Rows more
    than ``late`` behind their stream are not judged here; ``late.run_split`` keeps them.
    """
    right = answers.select(F.col(key).alias("_key"), F.col(answered).alias("_at"), *columns)
    if answers.isStreaming:
        right = right.withWatermark("_at", late)
    bound = ((F.col(key) == F.col("_key")) & (F.col("_at") >= F.col(ts))
             & (F.col("_at") <= F.col(ts) + F.expr(f"interval {wait}")))
    return requests.join(right, bound, "left_outer").drop("_key", "_at")


def stream_detect_with_scores(requests: DataFrame, classifier: DataFrame, entailment: DataFrame,
                              key: str = "event_id", ts: str = "ts", wait: str = WAIT, late: str = WAIT,
                              **options) -> DataFrame:
    """Decisions of ``detect`` from requests and both scorers' answers, on streams or in batch.

    requests: key, event time, context, answer, gold_label, mode; classifier: key, answered, label,
    conf; entailment: key, answered, sup, con, nli_decision, any_contra, any_unsupp.  A request
    appears once, when both scores are there or their time is over.
    """
    if requests.isStreaming:
        requests = requests.withWatermark(ts, late)
    first = with_scores_in_time(requests, classifier, CLASSIFIER, key, ts, wait=wait, late=late)
    both = with_scores_in_time(first, entailment, ENTAILMENT, key, ts, wait=wait, late=late)
    return detect(both, **options)

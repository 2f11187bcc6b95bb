"""Claim verdicts -> answer decision, and rule-based rewriting, inside one row.

``claims`` is array<struct<claim,label,score,error_type,evidence_span,explanation>> in
answer order.  All claims of an answer come from that answer's own text, so the array is
bounded by the row and needs no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.numbers import EXACT, ratio, round_to
from claimlens.functions.scores import two_digits
from claimlens.functions.text import strip

COUNTED = ("supported", "contradicted", "unsupported", "partially_supported",
           "insufficient_context")


def counted_label(label: Column) -> Column:
    """Labels outside the vocabulary count as unsupported."""
    return F.when(label.isin(list(COUNTED)), label).otherwise(F.lit("unsupported"))


def policy_rule(n: Column, counts: dict[str, Column], score: Column,
                policy: fv.AnswerPolicy = fv.AnswerPolicy()) -> Column:
    """struct<final_decision, action_message, retrieval_needed> from label counts."""
    sup, con = counts["supported"], counts["contradicted"]
    uns, par = counts["unsupported"], counts["partially_supported"]
    ins = counts["insufficient_context"]

    def out(decision: str, message: Column, retrieval: bool = False) -> Column:
        return F.struct(
            F.lit(decision).alias("final_decision"),
            message.alias("action_message"),
            F.lit(retrieval).alias("retrieval_needed"),
        )

    single = n == 1
    weak = par + uns
    return (
        F.when(n == 0, out("warn", F.lit(fv.NO_CLAIMS_MESSAGE)))
        .when(single & (sup == 1), out("accept", F.lit("Single claim supported by context.")))
        .when(
            single & (par == 1),
            out("warn", F.lit("Single claim only partially supported by context.")),
        )
        .when(
            single & (uns == 1),
            out("warn", F.lit("Single claim not found in context. "
                              "Answer may contain unverified information.")),
        )
        .when(
            single & (con == 1),
            out("revise", F.lit("Single claim contradicted by context. "
                                "Revise or remove the incorrect statement.")),
        )
        .when(
            single,
            out("insufficient_context", F.lit("Cannot verify claim — insufficient context. "
                                              "Additional retrieval needed."), True),
        )
        .when(
            sup == n,
            out("accept", F.concat(
                F.format_string("All %d/%d claims supported by context. "
                                "Aggregate hallucination score: ", n, n),
                two_digits(score), F.lit("."))),
        )
        .when(
            ins == n,
            out("insufficient_context", F.format_string(
                "All %d/%d claims cannot be verified with current context. "
                "Additional retrieval needed.", n, n), True),
        )
        .when(
            ins > 0,
            out("insufficient_context", F.format_string(
                "%d/%d claim(s) cannot be verified with current context. "
                "Additional retrieval needed.", ins, n), True),
        )
        .when(
            (con >= policy.reject_min_contradicted) & (con > 0) & (sup == 0),
            out("reject", F.format_string(
                "%d/%d claim(s) directly contradicted, none supported. "
                "Answer is unreliable.", con, n)),
        )
        .when(
            con > 0,
            out("revise", F.format_string(
                "%d/%d claim(s) contradicted by context. "
                "Revise or remove the contradicted parts.", con, n)),
        )
        .otherwise(
            out("warn", F.format_string(
                "%d/%d claim(s) not fully supported by context. "
                "Answer may contain unverified information.", weak, n))
        )
    )


def _count(claims: Column, label: str) -> Column:
    return F.size(F.filter(claims, lambda c: counted_label(c["label"]) == label))


def answer_policy(claims: Column, policy: fv.AnswerPolicy = fv.AnswerPolicy()) -> Column:
    """Decision struct of one answer: decision, message, mean score and label counts."""

    def build(tally: Column) -> Column:
        n = tally["n_claims"]
        counts = {name: tally[f"n_{name}"] for name in COUNTED}
        rule = policy_rule(n, counts, tally["score"], policy)
        return let(
            rule,
            lambda r: F.struct(
                r["final_decision"].alias("final_decision"),
                r["action_message"].alias("action_message"),
                r["retrieval_needed"].alias("retrieval_needed"),
                round_to(tally["score"], 4).alias("aggregate_hallucination_score"),
                n.alias("n_claims"),
                *[counts[name].alias(f"n_{name}") for name in COUNTED],
            ),
        )

    total = F.aggregate(
        claims, F.lit(0).cast("decimal(28,9)"),
        lambda acc, c: (acc + c["score"].cast(EXACT)).cast("decimal(28,9)"),
    )
    tally = F.struct(
        F.size(claims).alias("n_claims"),
        F.when(F.size(claims) > 0, ratio(total, F.size(claims))).otherwise(0.5).alias("score"),
        *[_count(claims, name).alias(f"n_{name}") for name in COUNTED],
    )
    return let(tally, build)


def flagged_claims(claims: Column, policy: fv.AnswerPolicy = fv.AnswerPolicy()) -> Column:
    return F.filter(claims, lambda c: c["score"] >= policy.flag_claim_score)


def most_severe(decisions: Column) -> Column:
    """Most severe decision of an array<string>; accept when there is none."""
    return F.coalesce(
        *[F.when(F.array_contains(decisions, d), F.lit(d)) for d in fv.DECISION_SEVERITY],
        F.lit("accept"),
    )


# What each strategy does per label; labels not listed are kept.
STRATEGIES = {
    "drop": {"contradicted": "drop", "unsupported": "drop", "partially_supported": "hedge"},
    "hedge": {"contradicted": "drop", "unsupported": "hedge", "partially_supported": "hedge"},
    "replace": {"contradicted": "replace", "unsupported": "drop"},
    "truncate": {"contradicted": "remove", "unsupported": "remove",
                 "partially_supported": "remove", "insufficient_context": "remove"},
}


def _cut_for_log(claim: Column, strategy: str) -> Column:
    if strategy == "drop":
        short = F.concat(F.substring(claim, 1, 80), F.lit("..."))
        return F.when(F.length(claim) > 80, short).otherwise(claim)
    return F.substring(claim, 1, 60)


def _step(claim: Column, strategy: str) -> Column:
    """struct<action, text, log> for one claim; null text means it disappears."""
    text, label, span = claim["claim"], claim["label"], claim["evidence_span"]
    other = "remove" if strategy == "truncate" else "keep"
    action = F.lit(other)
    if strategy == "truncate":
        action = F.when(label == "supported", F.lit("keep")).otherwise(action)
    for name, what in STRATEGIES[strategy].items():
        if what == "replace":
            chosen = F.when(F.length(span) > 0, F.lit("replace")).otherwise(F.lit("drop"))
        else:
            chosen = F.lit(what)
        action = F.when(label == name, chosen).otherwise(action)

    def build(a: Column) -> Column:
        verb = (
            F.when(a == "drop", "DROPPED").when(a == "hedge", "HEDGED")
            .when(a == "remove", "REMOVED").otherwise("KEPT")
        )
        plain = F.concat(verb, F.lit(" ["), label, F.lit("]: "), _cut_for_log(text, strategy))
        swapped = F.concat(
            F.lit("REPLACED [contradicted]: '"), F.substring(text, 1, 50), F.lit("' → '"),
            F.substring(span, 1, 50), F.lit("'"),
        )
        return F.struct(
            a.alias("action"),
            F.when(a == "keep", text)
            .when(a == "hedge", F.concat(text, F.lit(fv.HEDGE_SUFFIX)))
            .when(a == "replace", strip(span))
            .alias("text"),
            F.when(a == "replace", swapped).otherwise(plain).alias("log"),
        )

    return let(action, build)


def revise(strategy: str, answer: Column, claims: Column, decision: Column) -> Column:
    """Rewrite an answer from its verdicts.

    struct<revised_answer, n_claims_removed, n_claims_hedged, n_claims_replaced,
    n_claims_kept, revision_log, no_revision_needed>.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown revision strategy {strategy!r}, use {sorted(STRATEGIES)}")

    def out(text, removed, hedged, replaced, kept, log, unneeded=False) -> Column:
        return F.struct(
            text.alias("revised_answer"), removed.alias("n_claims_removed"),
            hedged.alias("n_claims_hedged"), replaced.alias("n_claims_replaced"),
            kept.alias("n_claims_kept"), log.alias("revision_log"),
            F.lit(unneeded).alias("no_revision_needed"),
        )

    def rewritten(steps: Column) -> Column:
        def n(*actions: str) -> Column:
            return F.size(F.filter(steps, lambda s: s["action"].isin(list(actions))))

        texts = F.filter(F.transform(steps, lambda s: s["text"]), lambda t: t.isNotNull())
        logs = F.transform(steps, lambda s: s["log"])
        empty = F.size(texts) == 0
        fallback = fv.FALLBACK_ANSWER
        if strategy == "drop":
            fallback = fv.FALLBACK_ANSWER_DROP
            logs = F.when(empty, F.array_append(logs, F.lit(fv.FALLBACK_LOG))).otherwise(logs)
        # The hedging strategy reports no removals; the dropping one counts hedged as kept.
        removed = F.lit(0) if strategy == "hedge" else n("drop", "remove")
        kept = n("keep", "hedge") if strategy == "drop" else n("keep")
        return out(
            F.when(empty, F.lit(fallback)).otherwise(F.array_join(texts, " ")),
            removed, n("hedge"), n("replace"), kept, logs,
        )

    zero = F.lit(0)
    return (
        F.when(
            decision == "accept",
            out(answer, zero, zero, zero, F.size(claims),
                F.array(F.lit(fv.NO_REVISION_LOG)), True),
        )
        .when(
            F.size(claims) == 0,
            out(answer, zero, zero, zero, zero, F.array(F.lit(fv.NO_CLAIMS_LOG))),
        )
        .otherwise(let(F.transform(claims, lambda c: _step(c, strategy)), rewritten))
    )


def summary_line(d: Column) -> Column:
    """One line per answer from an :func:`answer_policy` struct."""
    from claimlens.functions.labels import lookup

    return F.concat(
        lookup(d["final_decision"], fv.DECISION_ICONS, "?"), F.lit(" "),
        F.upper(d["final_decision"]), F.lit(" | score="),
        two_digits(d["aggregate_hallucination_score"]),
        F.format_string(
            " | %d claims: %d✓ %d✗ %d? %d~ %d∅", d["n_claims"], d["n_supported"],
            d["n_contradicted"], d["n_unsupported"], d["n_partially_supported"],
            d["n_insufficient_context"],
        ),
    )

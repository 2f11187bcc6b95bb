"""Decision, answer and output rules, one case per branch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions import answers as an
from claimlens.functions import fusion as fu
from claimlens.functions import labels as lb
from claimlens.functions import outputs as op
from claimlens.functions import scores as sc
from claimlens.operators import guards

L = F.lit


@pytest.mark.parametrize(("sup", "con", "kw", "want"), [
    (0.9, 0.3, 0.0, "revise"), (0.8, 0.29, 0.0, "accept"), (0.3, 0.0, 0.0, "warn"),
    (0.29, 0.0, 0.05, "warn"), (0.29, 0.0, 0.04, "insufficient_context"),
])
def test_nli_policy(one, sup, con, kw, want):
    assert one(sc.nli_policy(L(sup), L(con), L(kw))) == want


def test_softmax_guards_bad_logits(one):
    got = one(sc.nli_scores(F.array(L(float("nan")), L(float("inf")), L(float("-inf")))))
    assert got["support"] == pytest.approx(0.000045, abs=1e-6)
    assert got["neutral"] == pytest.approx(0.999955, abs=1e-6)
    got = one(sc.class_probs(F.array(*[L(0.0)] * 5)))
    assert got["predicted_label"] == "supported" and got["confidence"] == 0.2


@pytest.mark.parametrize(("label", "conf", "sup", "con", "n", "contra", "unsupp", "want"), [
    ("supported", 0.9, 0.9, 0.8, 1, None, None, ("revise", "nli_veto")),
    ("supported", 0.9, 0.79, 0.1, 1, None, None, ("warn", "bert_supported_veto")),
    ("partially_supported", 0.9, 0.5, 0.1, 1, None, None, ("warn", "bert_partial_fallback")),
    ("partially_supported", 0.9, 0.5, 0.1, 2, True, True, ("revise", "claim_level_nli")),
    ("partially_supported", 0.9, 0.5, 0.1, 2, False, True, ("warn", "claim_level_nli")),
    ("partially_supported", 0.9, 0.5, 0.1, 2, None, None, ("warn", "claim_level_nli")),
    ("partially_supported", 0.9, 0.5, 0.1, 2, False, False, ("accept", "claim_level_nli")),
    ("contradicted", 0.9, 0.8, 0.1, 2, True, True, ("revise", "conflict_claim_level_nli")),
    ("contradicted", 0.9, 0.8, 0.1, 2, False, True, ("warn", "conflict_safe_warn")),
    ("contradicted", 0.9, 0.8, 0.1, 1, True, True, ("warn", "conflict_safe_warn")),
    ("supported", 0.9, 0.85, 0.09, 1, None, None, ("accept", "nli_strong_support")),
    ("unsupported", 0.9, 0.5, 0.2, 1, None, None, ("warn", "fallback_warn")),
])
def test_fuse(one, label, conf, sup, con, n, contra, unsupp, want):
    got = one(fu.fuse(L(label), L(conf), L(sup), L(con), L(n), L(contra).cast("boolean"),
                      L(unsupp).cast("boolean")))
    assert (got["decision"], got["source"]) == want


def test_no_info_phrase(one):
    answer = "Baglamda bu soruyu yanitlayacak bilgi yer almiyor."
    assert one(fu.no_info_phrase(L(answer))) == fv.NO_INFO_PHRASES[0]
    folded = "Bağlamda bu konuda veri yok"
    assert one(fu.no_info_phrase(L(folded))) is None
    assert one(fu.no_info_phrase(L(folded), fold=True)) == "baglamda bu konuda"


def test_gold_accepts(one):
    assert one(lb.gold_accepts(L(" Unsupported "), L("revise"))) is True
    assert one(lb.gold_accepts(L("contradicted"), L("warn"))) is False
    assert one(lb.gold_accepts(L("odd"), L("warn"))) is None
    assert one(lb.gold_accepts(L("odd"), L("warn"), False)) is False
    assert one(lb.gold_accepts(L(""), L("warn"), False)) is None


def test_clamp(one):
    assert one(lb.clamp_score(L("contradicted"), L(0.5))) == 0.8
    assert one(lb.clamp_score(L("other"), L(0.123456))) == 0.1235


def verdicts(spark, labels, spans=None):
    spans = spans or [""] * len(labels)
    data = [([(f"Claim {i}.", x, 0.5, "none", s, "") for i, (x, s) in
              enumerate(zip(labels, spans, strict=True))],)]
    return spark.createDataFrame(
        data, "claims array<struct<claim:string,label:string,score:double,error_type:string,"
              "evidence_span:string,explanation:string>>")


@pytest.mark.parametrize(("labels", "want"), [
    (["contradicted"], "revise"), (["contradicted", "contradicted"], "reject"),
    (["supported", "contradicted"], "revise"),
    (["insufficient_context", "contradicted"], "insufficient_context"),
    (["supported", "unsupported"], "warn"), ([], "warn"), (["supported"], "accept"),
    (["supported", "supported"], "accept"), (["partially_supported"], "warn"),
    (["strange"], "warn"), (["insufficient_context"], "insufficient_context"),
    (["insufficient_context"] * 2, "insufficient_context"),
])
def test_answer_policy(spark, labels, want):
    row = verdicts(spark, labels).select(an.answer_policy(F.col("claims")).alias("p")).first()["p"]
    assert row["final_decision"] == want
    assert row["aggregate_hallucination_score"] == 0.5
    assert row["retrieval_needed"] == (want == "insufficient_context")


def revised(spark, strategy, labels, spans=None, decision="revise"):
    df = verdicts(spark, labels, spans)
    return df.select(
        an.revise(strategy, L("Original."), F.col("claims"), L(decision)).alias("r")
    ).first()["r"]


def test_revise(spark):
    labels = ["supported", "contradicted", "partially_supported", "unsupported"]
    spans = ["", " Right. ", "", ""]
    drop = revised(spark, "drop", labels)
    assert drop["revised_answer"] == f"Claim 0. Claim 2.{fv.HEDGE_SUFFIX}"
    assert (drop["n_claims_removed"], drop["n_claims_hedged"], drop["n_claims_kept"]) == (2, 1, 2)
    hedge = revised(spark, "hedge", labels)
    assert (hedge["n_claims_removed"], hedge["n_claims_hedged"], hedge["n_claims_kept"]) == (0, 2, 1)
    replace = revised(spark, "replace", labels, spans)
    assert replace["revised_answer"] == "Claim 0. Right. Claim 2."
    assert replace["revision_log"][1] == "REPLACED [contradicted]: 'Claim 1.' → ' Right. '"
    truncate = revised(spark, "truncate", labels)
    assert truncate["revised_answer"] == "Claim 0." and truncate["n_claims_removed"] == 3
    assert truncate["revision_log"][1] == "REMOVED [contradicted]: Claim 1."


def test_revise_edges(spark):
    gone = revised(spark, "drop", ["contradicted"])
    assert gone["revised_answer"] == fv.FALLBACK_ANSWER_DROP
    assert gone["revision_log"][-1] == fv.FALLBACK_LOG
    assert revised(spark, "drop", ["contradicted"], decision="accept")["no_revision_needed"]
    assert revised(spark, "hedge", [])["revision_log"] == [fv.NO_CLAIMS_LOG]
    with pytest.raises(ValueError, match="unknown revision strategy"):
        an.revise("shrink", L("a"), F.array(), L("revise"))


GOOD = '{"label": "contradicted", "hallucination_score": 1.7, "error_type": "odd", "explanation": "e"}'


@pytest.mark.parametrize(("raw", "tier", "label"), [
    (f"  {GOOD}\n", 1, "contradicted"), (f"Yanıt: {GOOD} ok {{", 2, "contradicted"),
    (f"{GOOD} {GOOD}", 2, "contradicted"),
    (f'pre {{"explanation": "a }} b", "label": "supported"', 3, "supported"),
    ("the label is partially_supported here", 3, "partially_supported"),
    ('{"label": "supported", "evidence_span": null}', 3, "supported"),
    ("", 4, "insufficient_context"), ("nothing", 4, "insufficient_context"),
    ("[1, 2]", 4, "insufficient_context"), ("{broken", 4, "insufficient_context"),
])
def test_parse_tiers(one, raw, tier, label):
    got = one(op.parse_output(L(raw)))
    assert (got["tier"], got["label"]) == (tier, label)
    assert got["parse_error"] == (tier > 2)


def test_parse_defaults(one):
    got = one(op.parse_output(L(GOOD)))
    assert (got["hallucination_score"], got["error_type"], got["decision"]) == (1.0, "none", "warn")
    got = one(op.parse_output(L('x "label": "unsupported", "decision": "odd"')))
    assert (got["hallucination_score"], got["error_type"]) == (0.75, "unsupported_inference")
    assert (got["decision"], got["explanation"]) == ("warn", fv.NO_EXPLANATION)
    got = one(op.parse_output(L('{"label": "supported", "hallucination_score": "0.25"}')))
    assert (got["hallucination_score"], got["tier"]) == (0.25, 1)


def test_balanced_block(one):
    assert one(op.balanced_block(L('a {"x": {"y": 1}} {"z": 2}'))) == '{"x": {"y": 1}}'
    assert one(op.balanced_block(L("no braces"))) is None
    assert one(op.balanced_block(L("{ open"))) is None


def test_guards_in_order(spark):
    cols = ("claim string, context string, label string, hallucination_score double, "
            "error_type string, evidence_span string, explanation string, parse_error boolean")
    rows = [
        ("c", "x", "supported", 0.05, "none", " ", "why", False),
        ("c", "bağlam metni burada", "supported", 0.05, "none", "uydurma alıntı", "", False),
        ("c", "verilen claim doğru", "supported", 0.05, "none", "verilen claim", "", False),
        ("kitap yazar ödül", "kitap ve yazar için ödül", "unsupported", 0.9, "none", "", "", False),
        ("A, B içermez", "B içermez denir", "contradicted", 0.9, "entity_error", "B içermez", "",
         False),
        ("c", "x", "contradicted", 0.9, "entity_error", "", "", False),
        ("c", "x", "supported", 0.05, "none", "", "", True),
    ]
    got = guards.apply_guards(spark.createDataFrame(rows, cols)).collect()
    assert [r["label"] for r in got] == [
        "partially_supported", "supported", "supported", "partially_supported", "supported",
        "unsupported", "supported",
    ]
    assert got[0]["hallucination_score"] == 0.35
    assert got[0]["explanation"] == f"why  [{fv.NOTE_MISSING_SPAN}]"
    assert got[1]["evidence_span"] is None and got[2]["evidence_span"] is None
    assert "(örtüşme: 100%)" in got[3]["explanation"] and got[3]["hallucination_score"] == 0.5
    assert got[4]["hallucination_score"] == 0.15 and got[4]["error_type"] == "none"
    assert got[5]["hallucination_score"] == 0.8 and got[5]["original_label"] == "contradicted"

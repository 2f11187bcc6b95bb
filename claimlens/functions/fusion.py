"""Rules that combine the classifier and the entailment scorer for one answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.labels import label_attr
from claimlens.functions.scores import blended_score, classifier_danger, nli_danger, two_digits
from claimlens.functions.text import strip


def route(mode: Column) -> Column:
    """Executed mode: an explicit one, else both scorers."""
    return F.when(F.coalesce(mode, F.lit("auto")) == "auto", F.lit("ensemble")).otherwise(mode)


def no_info_phrase(answer: Column, phrases=fv.NO_INFO_PHRASES, fold: bool = False) -> Column:
    """First listed "no information" phrase found in the answer, else null.

    ``fold`` maps Turkish letters to their ASCII base first.
    """
    lowered = F.lower(answer)
    if fold:
        lowered = F.translate(lowered, "ığüşöç", "igusoc")
    return F.coalesce(
        *[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in phrases], F.lit(None)
    )


def effective_question(question: Column, fallback: Column) -> Column:
    return F.when(F.length(strip(question)) >= 3, question).otherwise(fallback)


def effective_claim(claim: Column, answer: Column) -> Column:
    return F.when(F.length(claim) > 0, claim).otherwise(answer)


def claim_contradicted(sup: Column, con: Column, decision: Column,
                       rules: fv.FusionRules = fv.FusionRules()) -> Column:
    return F.coalesce((decision == "revise") | (con >= rules.claim_con), F.lit(False))


def claim_unsupported(sup: Column, con: Column, decision: Column,
                      rules: fv.FusionRules = fv.FusionRules()) -> Column:
    """Weak or missing support; a claim without scores counts as unsupported."""
    weak = decision.isin("warn", "insufficient_context") | (sup < rules.claim_sup)
    return F.coalesce(~claim_contradicted(sup, con, decision, rules) & weak, F.lit(True))


def rollup_claims(claim_scores: Column, rules: fv.FusionRules = fv.FusionRules()) -> Column:
    """struct<any_contra, any_unsupp> over array<struct<sup, con, decision>>; no shuffle."""
    return F.struct(
        F.exists(
            claim_scores, lambda c: claim_contradicted(c["sup"], c["con"], c["decision"], rules)
        ).alias("any_contra"),
        F.exists(
            claim_scores, lambda c: claim_unsupported(c["sup"], c["con"], c["decision"], rules)
        ).alias("any_unsupp"),
    )


def _outcome(decision: str, source: str, confidence: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(decision).alias("decision"),
        F.lit(source).alias("source"),
        confidence.cast("double").alias("confidence"),
        reason.alias("reason"),
    )


def fuse(label: Column, conf: Column, sup: Column, con: Column, n_sentences: Column,
         any_contra: Column, any_unsupp: Column,
         rules: fv.FusionRules = fv.FusionRules()) -> Column:
    """struct<decision, source, confidence, reason>; the first matching rule decides.

    ``any_contra`` / ``any_unsupp`` summarise the sentence-level scores.  Null means
    that they are not available, which counts as unsupported.
    """
    contra = F.coalesce(any_contra, F.lit(False))
    unsupp = F.coalesce(any_unsupp, F.lit(True))
    several = n_sentences > 1
    partial = label == "partially_supported"
    conflict = (label == "contradicted") & (sup >= rules.min_sup)
    txt = F.lit
    return (
        F.when(
            con >= rules.veto_con,
            _outcome("revise", "nli_veto", con, F.concat(
                txt("Güçlü NLI çelişkisi (con="), two_digits(con), txt(")"))),
        )
        .when(
            (sup < rules.min_sup) & (label == "supported"),
            _outcome("warn", "bert_supported_veto", conf, F.concat(
                txt("BERT supported verdi ama NLI desteği yetersiz (sup="), two_digits(sup),
                txt(")"))),
        )
        .when(
            partial & several & contra,
            _outcome("revise", "claim_level_nli", conf, txt(
                "BERT partial dedi; iddia seviyesinde çelişki bulundu.")),
        )
        .when(
            partial & several & unsupp,
            _outcome("warn", "claim_level_nli", conf, txt(
                "BERT partial dedi; iddia seviyesinde yetersiz destek bulundu.")),
        )
        .when(
            partial & several,
            _outcome("accept", "claim_level_nli", conf, txt(
                "BERT partial dedi; tüm iddialar başarıyla desteklendi.")),
        )
        .when(
            partial,
            _outcome("warn", "bert_partial_fallback", conf, txt(
                "BERT kısmi destek dedi (tek cümle).")),
        )
        .when(
            conflict & several & contra,
            _outcome("revise", "conflict_claim_level_nli", conf, txt(
                "BERT çelişki bildirdi; iddia seviyesinde çelişen alt cümle doğrulandı.")),
        )
        .when(
            conflict,
            _outcome("warn", "conflict_safe_warn", F.greatest(conf, sup), F.concat(
                txt("Uyuşmazlık: BERT çelişki ("), two_digits(conf),
                txt(") derken NLI destek ("), two_digits(sup),
                txt(") bildirdi. Güvenli karar: WARN"))),
        )
        .when(
            (sup >= rules.accept_sup) & (con < rules.accept_con),
            _outcome("accept", "nli_strong_support", sup, F.concat(
                txt("Güçlü NLI desteği (sup="), two_digits(sup), txt(", con="),
                two_digits(con), txt(")"))),
        )
        .otherwise(
            _outcome("warn", "fallback_warn", F.greatest(sup, con), F.concat(
                txt("Düşük/belirsiz destek: NLI sup="), two_digits(sup), txt(", con="),
                two_digits(con))),
        )
    )


def decide(routing: Column, phrase: Column, label: Column, conf: Column, sup: Column,
           con: Column, nli_decision: Column, fused: Column,
           rules: fv.FusionRules = fv.FusionRules()) -> Column:
    """Final outcome from whichever scores exist (null label / null sup = scorer failed).

    struct<decision, source, confidence, reason, score, routing>.  The phrase rule comes
    first; a missing scorer falls back to the other one; neither means warn.
    """
    has_cls = label.isNotNull() & (routing != "nli")
    has_nli = sup.isNotNull() & (routing != "bert")
    mapped = label_attr(label, "default_decision", "warn")
    cls_score, nli_score = classifier_danger(label, conf), nli_danger(sup, con, rules)
    best = F.greatest(sup, con)

    def row(decision, source, confidence, reason, score, route_name=routing) -> Column:
        return F.struct(
            decision.alias("decision"), source.alias("source"),
            confidence.cast("double").alias("confidence"), reason.alias("reason"),
            score.cast("double").alias("score"), route_name.alias("routing"),
        )

    return (
        F.when(
            phrase.isNotNull(),
            row(F.lit("insufficient_context"), F.lit("keyword_rule"), F.lit(0.95),
                F.concat(F.lit("Cevap 'bilgi yok' ifadesi iceriyor: '"), phrase, F.lit("'")),
                F.lit(0.20), F.lit("keyword_rule")),
        )
        .when(
            (routing == "bert") & has_cls,
            row(mapped, F.lit("bert"), conf,
                F.concat(F.lit("BERT: "), label, F.lit(" ("), two_digits(conf), F.lit(")")),
                cls_score),
        )
        .when(
            (routing == "nli") & has_nli,
            row(nli_decision, F.lit("nli"), best,
                F.concat(F.lit("NLI: sup="), two_digits(sup), F.lit(", con="), two_digits(con)),
                nli_score),
        )
        .when(
            has_cls & has_nli,
            row(fused["decision"], fused["source"], fused["confidence"], fused["reason"],
                blended_score(fused["decision"], label, conf, sup, con, rules)),
        )
        .when(
            has_cls,
            row(mapped, F.lit("bert_fallback"), conf,
                F.concat(F.lit("NLI hatası, BERT fallback: "), label), cls_score),
        )
        .when(
            has_nli,
            row(nli_decision, F.lit("nli_fallback"), best,
                F.lit("BERT hatası, NLI fallback"), nli_score),
        )
        .otherwise(
            row(F.lit("warn"), F.lit("error"), F.lit(0.0),
                F.lit("Her iki model de başarısız"), F.lit(0.5)),
        )
    )

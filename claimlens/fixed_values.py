"""Vocabularies, word lists, thresholds and message texts.

Every value in this file is part of the data contract (results depend on it
literally), so they are written down plainly in one place.  All functions
take these as defaults and accept replacements, because the lists are Turkish
and other corpora need their own.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: vocabularies -------------------------------------------------
LABELS = (
    "supported", "partially_supported", "unsupported", "contradicted", "insufficient_context",
)
DECISIONS = ("accept", "warn", "revise", "reject", "web_check", "insufficient_context")
ERROR_TYPES = (
    "entity_error", "date_number_error", "relation_error", "attribution_error",
    "unsupported_inference", "fabricated_source", "constraint_violation", "omission",
    "negation_error", "overgeneralization", "none",
)
SPLITS = ("train", "validation", "test")
SOURCE_TYPES = ("synthetic",)
DOMAINS = (
    "literature", "history", "geography", "science", "technology", "education", "health",
    "law", "other",
)
NLI_LABELS = ("supported", "neutral", "contradicted")
ID_PREFIX = "trrag_"

# --- Fixed values: one row per label ---------------------------------------------
# label, score_lo, score_hi, typical score, default decision, 3-way label, binary label,
# risk, danger weight
LABEL_ROWS = (
    ("supported", 0.00, 0.15, 0.05, "accept", "supported", "supported", "safe", 0.0),
    ("partially_supported", 0.20, 0.50, 0.35, "warn", "neutral", "unsupported", "unsafe", 0.40),
    ("unsupported", 0.60, 0.85, 0.75, "warn", "neutral", "unsupported", "unsafe", 0.70),
    ("contradicted", 0.80, 1.00, 0.95, "revise", "contradicted", "unsupported", "unsafe", 1.0),
    ("insufficient_context", 0.30, 0.60, 0.45, "insufficient_context", "neutral", "unsupported",
     "unsafe", 0.25),
)
LABEL_FIELDS = (
    "label", "score_lo", "score_hi", "typical", "default_decision", "nli3", "binary", "risk",
    "danger_weight",
)
# Decisions counted as right for a gold label (or a gold decision).
GOLD_ACCEPTS = {
    "supported": ("accept",),
    "partially_supported": ("warn", "revise"),
    "unsupported": ("warn", "revise", "insufficient_context"),
    "contradicted": ("revise",),
    "insufficient_context": ("insufficient_context",),
    "accept": ("accept",),
    "warn": ("warn",),
    "revise": ("revise",),
}
DECISION_SEVERITY = ("reject", "revise", "web_check", "warn", "insufficient_context", "accept")
DECISION_ICONS = {"accept": "✓", "warn": "⚠", "revise": "✎", "reject": "✗", "web_check": "🔍"}

# --- Fixed values: text rules --------------------------------------------------------
TURKISH_UPPER_CHARS = "İIĞÜŞÖÇ"
TURKISH_LOWER_CHARS = "iığüşöç"
TOKENS_PER_WORD = 1.4
STOPWORDS = (
    "bir", "bu", "ve", "ile", "de", "da", "için", "olan", "olarak", "mi", "mu", "mı", "mü",
    "ki", "ne", "en", "çok", "daha", "ise", "ya", "veya", "hem", "ama", "ancak", "fakat",
    "lakin", "sadece", "yalnızca", "bile", "dahi", "gibi", "kadar", "sonra", "önce", "her",
    "tüm", "bütün", "hiç", "hiçbir", "bazı", "birçok", "çeşitli", "aynı", "farklı", "yeni",
    "eski", "büyük", "küçük", "iyi", "kötü", "doğru", "yanlış", "tam", "yarım", "az", "hep",
    "zaman", "yer", "şey", "var", "yok", "olur", "oldu", "olacak", "edilir", "edildi",
)
ABBREVIATIONS = (
    "Dr", "Prof", "Doç", "Yrd", "Öğr", "Gör", "Arş", "Uzm", "Mh", "Cad", "Sok", "Blv", "vb",
    "vs", "bkz", "örn", "mad", "No", "Sn", "Hz", "Haz", "Ağu", "Eyl", "Eki", "Kas", "Ara",
    "Oca", "Şub", "Mar", "Nis", "May", "Tem", "s", "sf", "sy", "vol", "ed", "çev",
)
DOT_PLACEHOLDER = "<DOT>"
CONJUNCTIONS = (
    " ve ayrıca ", " bunun yanı sıra ", " öte yandan ", " bununla birlikte ", " aynı zamanda ",
    " ama metne göre ", " fakat metne göre ", " ancak metne göre ", " ama bağlama göre ",
    " fakat bağlama göre ", " ancak bağlama göre ", " iken ", " oysa ", " halbuki ",
    " ne var ki ",
)
WEAK_CONJUNCTION = " ve "
TECH_NAMES = (
    "HTTP", "SSL", "TLS", "TCP", "UDP", "IP", "FTP", "SMTP", "DNS", "REST", "SOAP", "gRPC",
    "SQL", "NoSQL", "CSS", "HTML", "XML", "JSON", "YAML", "API", "SDK", "OS", "CPU", "GPU",
    "RAM", "ROM", "SSD", "HDD", "USB", "WiFi", "Bluetooth", "IPv4", "IPv6",
)
OPINION_WORDS = ("bence", "sanırım", "galiba", "olabilir", "belki", "muhtemelen", "tahmin")
MIN_CLAIM_CHARS = 10
FRAGMENT_ENDINGS = (
    "ve", "veya", "ile", "hakkında", "ilgili", "ise", "gibi", "için", "tarafından", "olarak",
    "adlı", "denilen", "adındaki", "adıyla",
)
NO_INFO_PHRASES = (
    "baglamda bu soruyu yanitlayacak bilgi", "baglamda bilgi yer alm", "baglamda bu bilgi",
    "bu soruyu yanitlayacak bilgi", "yeterli bilgi bulunm", "bilgi yer alm", "bilgi bulunm",
    "cevap veremiyorum", "bilgi mevcut degil", "baglamda yer alm", "baglamda bu konuda",
    "baglamda herhangi bir bilgi",
)
PLACEHOLDER_PHRASES = (
    "soru'da belirtilen claim", "soruda belirtilen claim", "claim'de belirtilen",
    "belirtilen claim", "yukarıdaki claim", "verilen claim",
)
NEGATION_WORDS = (
    "içermez", "içermiyor", "değildir", "değil", "gerektirmez", "gerektirmiyor", "yerine",
    "olmaz", "kullanmaz", "kullanmıyor", "dayanmaz", "dayanmıyor", "tutmaz", "tutmuyor",
    "sağlamaz", "sağlamıyor",
)
STUB_PATTERNS = (
    "bu madde bir taslaktır", "bu makale bir taslaktır", "stub", "bu kısa makale",
)
DISAMBIGUATION_PATTERNS = ("anlam ayrımı", "bu sayfa.*anlam", "disambiguation")
MACHINE_TRANSLATION_PATTERNS = ("bu makale.*çevrilmiştir", "otomatik çeviri")
CAPITALS = "A-ZÇĞİÖŞÜ"
SMALLS = "a-zçğışöü"
CHUNK_SEPARATOR = "\n\n---\n\n"
SOURCE_TAG = "Kaynak"
CONFLICT_SPAN_LABEL = "Evident Conflict"
DEFAULT_QUESTION = "Bu iddia dogru mu?"

# --- Fixed values: message texts ------------------------------------------------------
HEDGE_SUFFIX = " (bağlamda tam olarak doğrulanamadı)"
FALLBACK_ANSWER = "Bu soruya verilen cevap bağlam tarafından desteklenmemektedir."
FALLBACK_ANSWER_DROP = (
    "Bu soruya verilen cevap bağlam tarafından desteklenmemektedir. "
    "Lütfen soruyu farklı bir şekilde sorun veya daha fazla bilgi sağlayın."
)
FALLBACK_LOG = "All claims removed — fallback message used."
NO_REVISION_LOG = "No revision needed — all claims accepted."
NO_CLAIMS_LOG = "No claims to revise."
NO_CLAIMS_MESSAGE = "No claims extracted — cannot verify answer."
NO_EXPLANATION = "Açıklama üretilemedi."
NOTE_MISSING_SPAN = (
    "Bağlamda bu iddiayı destekleyen bir alıntı bulunamadı; "
    "claim kısmen destekleniyor olarak işaretlendi."
)
NOTE_PARAPHRASE = (
    "Claim'in anahtar kelimeleri bağlamda bulundu (örtüşme: %s%%); "
    "model parafraz eşleştirmede başarısız olmuş olabilir."
)
NOTE_NEGATION = (
    "Claim olumsuzlama içeriyor ve bağlamdaki kanıt aynı olumsuzlamayı "
    "destekliyor; destekleniyor olarak düzeltildi."
)
NOTE_NO_CONFLICT_SPAN = (
    "Çelişki iddiası için bağlamdan kanıt metni bulunamadı; "
    "desteklenmiyor olarak düzeltildi."
)
NO_CONTEXT_ERROR = "No context provided in passthrough mode."
EMPTY_QUERY_ERROR = "Empty query after tokenization."
NO_PASSAGE_ERROR = "No relevant passages found in local corpus."

# --- Fixed values: dataset generation ---------------------------------------------------
LABEL_WEIGHTS = (
    ("supported", 0.33), ("contradicted", 0.20), ("unsupported", 0.20),
    ("partially_supported", 0.14), ("insufficient_context", 0.13),
)
ERROR_CHOICES = {
    "contradicted": ("entity_error", "date_number_error", "negation_error"),
    "unsupported": ("unsupported_inference", "fabricated_source", "overgeneralization"),
    "partially_supported": ("overgeneralization", "unsupported_inference", "omission"),
}
ERROR_HINTS = {
    "contradicted": "Hata türü önerisi: entity_error veya date_number_error "
                    "(bağlamla açıkça çelişen bir hata ekle)",
    "unsupported": "Hata türü önerisi: unsupported_inference veya overgeneralization "
                   "(bağlamda olmayan bir bilgi ekle)",
    "partially_supported": "Hata türü önerisi: overgeneralization veya omission "
                           "(kısmen desteklenen ama genişletilmiş bir iddia)",
    "insufficient_context": "Bağlam bu konuda karar vermek için yetersiz kalacak şekilde soru üret",
    "supported": "",
}


# --- Fixed values: thresholds --------------------------------------------------------------
@dataclass(frozen=True)
class NliPolicy:
    """Thresholds of the score policy."""

    p_contra: float = 0.30
    p_high: float = 0.80
    p_mid: float = 0.30
    t_kw: float = 0.05


@dataclass(frozen=True)
class FusionRules:
    """Thresholds and weights of the two-model decision."""

    veto_con: float = 0.80
    min_sup: float = 0.80
    accept_sup: float = 0.85
    accept_con: float = 0.10
    claim_con: float = 0.30
    claim_sup: float = 0.80
    classifier_weight: float = 0.15
    nli_weight: float = 0.85
    con_weight: float = 0.75
    unsup_weight: float = 0.25
    accept_ceiling: float = 0.15
    revise_floor: float = 0.85


@dataclass(frozen=True)
class AnswerPolicy:
    """Thresholds of the answer-level decision."""

    flag_claim_score: float = 0.50
    reject_min_contradicted: int = 2

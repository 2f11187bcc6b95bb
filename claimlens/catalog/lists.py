"""Word lists that occur in the (non-Turkish) tables, used instead of the Turkish defaults."""

CONJ = (" and ", " und ", " et ", " y ")
WEAK = " of "
ABBR = ("th", "er", "es", "nd", "re", "the")
OPINION = ("this", "dans", "nicht", "para")
STOP = ("that", "with", "from", "this", "thatin", "heheth", "orantion")
ENDINGS = ("the", "of", "de", "der", "and")
STUBS = ("thstor", "ononst an")
DISAMBIGUATION = ("edhe.*thatin", "nderund")
TRANSLATED = ("are.*hehely", "von den")
PHRASES = ("for the", "of and", "est un", "is a")
PLACEHOLDERS = ("of the", "de la", "tion in")
NEGATIONS = (" is ", " est ", " ist ", " es ")

CLAIM_LISTS = {
    "conjunctions": CONJ, "abbreviations": ABBR, "opinion_words": OPINION, "weak": WEAK,
}

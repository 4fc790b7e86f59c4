"""Text as Column functions: names, HTML, sentences, numbers in words, owners, redaction."""

from pyspark.sql import functions as F

#: Legal words dropped from company names, and corporate suffixes stripped from their end.
LEGAL_WORDS = ["inc", "corp", "corporation", "company", "co", "ltd", "llc", "plc", "the", "group", "holdings"]
SUFFIXES = "(?: (?:inc|corp|corporation|company|co|ltd|llc|plc|group|holdings))+$"
#: Words that make a sentence concrete, and words that hedge.
CONCRETE = r"\b(?:percent|million|billion|employees|hours|tons|reduced|increased|invested)\b|\d+"
HEDGES = r"\b(?:may|might|could|believe|aim|strive|seek|intend)\b"
TOPICS = r"\b(?:safety|training|diversity|turnover|union|benefits|wages|retention)\b"


def words_only(x):
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def normalised_name(x):
    """Lower-case words without legal words."""
    return F.array_join(F.filter(F.split(words_only(x), " "), lambda w: ~w.isin(LEGAL_WORDS)), " ")


def core_name(x):
    """The name without trailing suffixes; at least one word stays."""
    return F.regexp_replace(words_only(x), SUFFIXES, "")


def distinctive_words(x, common):
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]{3,}"), 0)), F.array(*map(F.lit, common)))


def slug(x):
    made = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", "profile").otherwise(made)


def html_text(x):
    """Visible text: scripts and styles out, tags to spaces, white space collapsed."""
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))


def inline_text(x):
    """As html_text(), with inline tags removed without a gap and block tags as line ends."""
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?i)</?(?:b|i|u|em|strong|span|font|a)(?: [^>]*)?>", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", "\n"), r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def scaled_number(x):
    """'1,234.5 million' and the like as a number."""
    n = F.expr("1").cast("double") * F.regexp_replace(F.regexp_extract(F.lower(x), r"([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")
    scale = F.when(F.lower(x).contains("billion"), 1e9).when(F.lower(x).contains("million"), 1e6).when(F.lower(x).contains("thousand"), 1e3).otherwise(1.0)
    return n * scale


def owners(x):
    """'A (74.3%); B' as an array of (name, share); without a percentage the share is 1."""
    one = lambda p: F.struct(
        F.trim(F.regexp_replace(p, r"\([\d.]+%\)", "")).alias("name"), F.coalesce(F.regexp_extract(p, r"\(([\d.]+)%\)", 1).try_cast("double") / 100, F.lit(1.0)).alias("share")
    )
    return F.filter(F.transform(F.split(x, ";"), one), lambda o: o["name"] != "")


#: Typographic punctuation and what stands for each.
FOLDED = ("‘’“”–— ", "''\"\"-- ")


def folded(x):
    """Typographic punctuation as ASCII."""
    return F.translate(x, *FOLDED)


def redacted(url):
    return F.regexp_replace(url, r"(?i)((?:api_?key|token|utm_source)=)[^&#]*", "$1***")


def sentences(x):
    return F.filter(F.transform(F.split(F.regexp_replace(x, "\n", " "), r"\. "), lambda s: F.trim(s)), lambda s: F.length(s) >= 20)


def sentence_score(s):
    low = F.lower(s)
    return 2 * F.when(F.regexp_count(low, F.lit(CONCRETE)) > 0, 1).otherwise(0) + F.regexp_count(low, F.lit(TOPICS)) - 2 * F.regexp_count(low, F.lit(HEDGES))


def topic_score(x):
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(TOPICS), 0)))


def contains_words(hay, needle):
    """Whether needle's words stand in hay's in a row."""
    return F.concat(F.lit(" "), hay, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))


def ticker(x):
    """Upper case, a dot before the class."""
    return F.replace(F.upper(F.trim(x)), F.lit("-"), F.lit("."))


def exchange_symbol(x):
    """Upper case, a dash before the class."""
    return F.translate(F.upper(F.trim(x)), "./", "--")


def padded(x, width: int):
    return F.lpad(F.trim(x.cast("string")), width, "0")


#: Suffixes left out of owners' names, of aliases, of court parties, and of recipients of contracts.
OWNER_SUFFIXES = "INCORPORATED|CORPORATION|COMPANY|HOLDINGS?|GROUP|LLC|LLP|LP|PLC|LTD|CORP|CO|INC|THE"
ALIAS_SUFFIXES = "inc|incorporated|corp|corporation|co|company|ltd|plc|lp|llc|sa|nv|the|new|de|md"
PARTY_SUFFIXES = "inc incorporated corp corporation co company companies ltd limited plc lp llp llc nv sa ag holding holdings group the new de md cl class a b".split()
RECIPIENT_SUFFIXES = "INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LLC|LTD|LIMITED|PLC|GROUP|HOLDINGS?"


def _collapsed(x):
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def owner_name(x):
    """Upper-case words of a facility owner's name without suffixes."""
    return _collapsed(F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9 ]", " "), rf"\b({OWNER_SUFFIXES})\b", " "))


def alias_name(x):
    """A loose form by which former names that equal the current one are found."""
    return _collapsed(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9 ]+", " "), rf"\b({ALIAS_SUFFIXES})\b", " "))


def party_core(x):
    """A court party's name without what stands in parentheses and without trailing suffixes; the first word stays."""
    plain = _collapsed(F.regexp_replace(F.regexp_replace(F.lower(x), r"\([^)]*\)", " "), "[^a-z0-9 ]+", " "))
    return F.regexp_replace(plain, rf"( ({'|'.join(PARTY_SUFFIXES)}))+$", "")


def recipient_name(x):
    """A legal name as contracts are searched by: without a state tag and trailing legal forms."""
    bare = F.regexp_replace(x, r"\s*/[A-Z]{2,3}/?\s*$", "")
    return F.trim(F.regexp_replace(bare, rf"(?i)([,.]?\s*\b({RECIPIENT_SUFFIXES})\.?\s*)+$", ""))


def is_short(core):
    """Cores so short that they name other firms as well."""
    return F.length(core) <= 4


def whole_quote(x):
    """A quote cut by width, without the broken words at its ends, between ellipses."""
    x = _collapsed(x)
    x = F.when(~F.substring(x, 1, 1).rlike(r"^\p{Lu}") & x.contains(" "), F.regexp_replace(x, "^[^ ]+ ", "")).otherwise(x)
    x = F.when(~x.rlike(r'[.!?)"]$') & x.contains(" "), F.regexp_replace(x, " [^ ]*$", "")).otherwise(x)
    return F.concat(F.lit("…"), F.trim(F.replace(x, F.lit("�"), F.lit(""))), F.lit("…"))

"""Text as column expressions. All run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V

_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # ASCII word boundaries; \b knows accents in Java


def words_pattern(words: Iterable[str], ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _BEFORE + "(?:" + "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in words) + ")" + _AFTER


def either(texts: Iterable[str]) -> str:
    """Pattern of any of the texts as they are, inside words too."""
    return "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in texts)


def sentiment(text: Column) -> Column:
    """(P - N) / max(3, P + N + 1) of the good and bad words of the lower-cased text.

    One pass over the text finds the telling words; only those are told apart and counted.
    """
    telling = F.regexp_extract_all(F.lower(text), F.lit(words_pattern((*V.POSITIVE, *V.NEGATIVE))), F.lit(0))

    def score(found: Column) -> Column:
        good = F.size(F.filter(found, lambda w: w.isin(*V.POSITIVE)))
        return (2 * good - F.size(found)) / F.greatest(F.lit(3), F.size(found) + 1)

    return F.transform(F.array(telling), lambda found: F.when(found.isNotNull(), score(found)))[0]


def has_market_context(text: Column) -> Column:
    return text.rlike(words_pattern(V.MARKET, True))


def is_solicitation(text: Column) -> Column:
    """Class-action marketing: a plaintiff firm's name, or the topic together with a solicitation cue."""
    firm = text.rlike(rf"(?i){_BEFORE}(?:{'|'.join(V.LAW_FIRMS)}){_AFTER}")
    cue = text.rlike(words_pattern(V.SOLICITATION, True)) | text.rlike(rf"(?i){_BEFORE}{V.SOLICITATION_STEM}[A-Za-z0-9_]+{_AFTER}")
    return firm | (text.rlike(words_pattern(V.CLASS_ACTION_TOPIC, True)) & cue)


def headline_quality(title: Column) -> Column:
    """-1 empty, 0 templated or marketing, else 1, with 3 more for a catalyst word or 2 for an impact word."""
    templated = title.rlike("(?i)" + "|".join(V.SYNTHETIC_TITLES)) | title.rlike(r"(?i),\s*price\s+[+-]?\d")
    extra = F.when(title.rlike(words_pattern(V.CATALYST, True)), 3).when(title.rlike(words_pattern(V.IMPACT, True)), 2).otherwise(0)
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", -1).when(templated | is_solicitation(title), 0).otherwise(extra + 1)


def is_possible_ticker(token: Column, stop: Iterable[str] = V.TICKER_STOP_WORDS) -> Column:
    """One to five capitals and digits, a capital first, and no word that is a ticker in no form."""
    return token.rlike("^[A-Z][A-Z0-9]{0,4}$") & ~token.isin(*stop)


def is_common_word(ticker: Column) -> Column:
    return F.upper(ticker).isin(*V.COMMON_WORDS)


def is_gated(ticker: Column) -> Column:
    """Tickers that a bare word is no mention of: ambiguous ones, common words, single letters."""
    return ticker.isin(*V.AMBIGUOUS_TICKERS) | is_common_word(ticker) | (F.length(ticker) == 1)


def candidates(text: Column) -> Column:
    """array<struct<ticker, confidence>>: cashtag 3, `ticker: X` 2.6, (X) 2.4, bare capitals 1; a ticker once for each form.

    A pattern runs only over texts that hold the fixed text in it.
    """

    def rated(pattern: str, confidence: float) -> Column:
        mark = next((m for m, start in (("$", r"\$"), ("(", r"\("), ("ticker", f"{_BEFORE}ticker")) if pattern.startswith(start)), "")
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if mark:
            found = F.when(F.contains(text, F.lit(mark)) | text.isNull(), found).otherwise(F.array().cast("array<string>"))
        return F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("ticker"), F.lit(confidence).alias("confidence")))

    forms = [rated(*form) for form in V.TICKER_FORMS]
    forms[-1] = F.filter(forms[-1], lambda x: ~x["ticker"].isin(*V.AMBIGUOUS_TICKERS, *V.COMMON_WORDS))
    return F.filter(F.concat(*forms), lambda x: is_possible_ticker(x["ticker"]))


def ticker_candidates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ticker, confidence): the best form of each ticker that a text holds."""
    rows = df.select(key, F.explode(candidates(F.col(text))).alias("x")).select(key, "x.*")
    return rows.groupBy(key, "ticker").agg(F.max("confidence").alias("confidence"))


def once(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _decode_references(text: Column, mark: str, digits: str, base: int) -> Column:
    def decode(done: Column, ref: Column) -> Column:
        code = F.lpad(F.conv(ref, base, 16), 8, "0")
        valid = (F.length(ref) <= 7) & (code > "00000000") & (code <= "0010FFFF") & ~code.between("0000D800", "0000DFFF")
        char = F.decode(F.unhex(F.when(valid, code).otherwise("0000FFFD")), "UTF-32")
        return F.when(valid, F.replace(done, F.concat(F.lit(mark), ref, F.lit(";")), char)).otherwise(done)

    refs = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"{mark}({digits});"), F.lit(1)))
    return once(text, lambda t: F.when(F.contains(t, F.lit(mark)), F.aggregate(refs(t), t, decode)).otherwise(t))


def clean_markup(text: Column) -> Column:
    """Text of an XML fragment: sections and tags out, named then numeric references decoded, spaces collapsed.

    Numeric references are decoded through UTF-32, as `chr` stops at one byte; those of no
    character stay as they are.
    """
    out = F.regexp_replace(F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", ""), "<[^>]*>", " ")
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    for mark, digits, base in (("&#x", "[0-9a-fA-F]+", 16), ("&#", "[0-9]+", 10)):
        out = _decode_references(out, mark, digits, base)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def text_between(xml: Column, tag: str) -> Column:
    """Inside of the first such element, empty if none."""
    return F.regexp_extract(xml, rf"(?is)<{re.escape(tag)}[^>]*>(.*?)</{re.escape(tag)}>", 1)


def attr_between(xml: Column, tag: str, attr: str) -> Column:
    return F.regexp_extract(xml, rf"(?is)<{re.escape(tag)}[^>]*\s{re.escape(attr)}=[\"']([^\"']*)[\"']", 1)


def host_of(url: Column, fallback: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), fallback)


def article_of(url: Column) -> Column:
    """Title of a wiki url, null without one or with a bad encoding."""
    return F.nullif(F.replace(F.try_url_decode(F.regexp_extract(url, "/wiki/([^?#]+)", 1)), F.lit("_"), F.lit(" ")), F.lit(""))


def iso_week(date: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), date).cast("string"), 2, "0"))


def company_for_search(name: Column) -> Column:
    """A company's name without state tags, legal suffixes and punctuation."""
    plain = F.regexp_replace(name, r"(?i)/[a-z]{2}\s*$", " ")
    plain = F.regexp_replace(plain, rf"(?i){_BEFORE}(inc|incorporated|corp|corporation|company|co|ltd|limited|plc|holdings?|group|class [a-c]|common stock|the){_AFTER}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[.,&/]", " "), r"\s+", " "))


def brand_aliases(name: Column) -> Column:
    """Lower-case aliases of a company: the whole brand (two words, 6 characters) and its lead word (4 characters, not a general one)."""
    brand = F.lower(company_for_search(name))
    parts = F.split(brand, " ")
    whole = F.when((F.size(parts) > 1) & (F.length(brand) >= 6), brand)
    lead = F.when((F.length(parts[0]) >= 4) & ~parts[0].isin(*V.BRAND_STOP_WORDS) & ~is_common_word(parts[0]), parts[0])
    return F.when(brand.rlike("[a-z]"), F.array_distinct(F.array_compact(F.array(whole, lead)))).otherwise(F.array().cast("array<string>"))


def company_title(title: Column) -> Column:
    """Title case for names that are all capitals."""
    lower = F.lower(title)
    starts = F.regexp_extract_all(lower, F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1))  # runs of letters and of others
    last = lambda run: F.substring(run, -1, 1)
    cased = F.aggregate(starts, F.lit(""), lambda done, run: F.concat(done, F.when(run.rlike("^[a-z]") & ~last(done).rlike("[0-9_]"), F.concat(F.upper(F.substring(run, 1, 1)), F.substr(run, F.lit(2)))).otherwise(run)))
    return F.when(title == F.upper(title), cased).otherwise(title)


def spaced_camel_case(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), r"\s+", " "))


def first_sentences(text: Column, sentences: int, characters: int) -> Column:
    """The first sentences, cut to a number of characters with an ellipsis."""
    found = F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]+"), F.lit(0))
    out = F.trim(F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, sentences), " ")).otherwise(text))
    return F.when(F.length(out) > characters, F.concat(F.trim(F.substring(out, 1, characters - 1)), F.lit("…"))).otherwise(out)


def news_title(source: Column, title: Column) -> Column:
    """A headline for display: without the site and country that one source appends, references decoded."""
    plain = F.trim(F.regexp_replace(title, r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?i)\s+[a-z0-9.-]+\.[a-z]{2,}(\s+[a-z]{2,})?\s*$", ""), r"\s*\.\s*$", ""))
    out = F.when(source == "GDELT News", bare).otherwise(plain)
    for reference, char in (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def is_company_match(query: Column, title: Column, description: Column) -> Column:
    """Whether an article's title and one-line description are those of the company asked for."""

    def significant(x: Column) -> Column:
        words = F.split(F.regexp_replace(F.lower(x), "[^a-z0-9 ]+", " "), r"\s+")
        return F.filter(words, lambda w: (w != "") & ~w.isin(*V.COMPANY_STOP_WORDS))

    asked, named, about = significant(query), significant(title), F.lower(F.coalesce(description, F.lit("")))
    a_company = about.rlike(rf"{_BEFORE}(?:{'|'.join(V.COMPANY_KINDS)}){_AFTER}")
    another = about.rlike(rf"{_BEFORE}(?:{'|'.join(V.OTHER_KINDS)}){_AFTER}")
    covers = (F.size(F.array_except(named, asked)) == 0) | ((F.size(F.array_except(asked, named)) == 0) & a_company)
    return F.coalesce((F.size(asked) > 0) & (F.size(named) > 0) & covers & (~another | a_company), F.lit(False))


def timeline_points(json: Column) -> Column:
    """array<struct<date, value>> of a volume timeline, null where the text has none."""
    parsed = F.from_json(json, "timeline array<struct<data: array<struct<date: string, value: double>>>>")
    return parsed["timeline"][0]["data"]


def digits_to_timestamp(text: Column, default: Column) -> Column:
    """Timestamp of 8 or 14 digits, a T and Z between allowed; `default` for anything else."""
    digits = F.regexp_replace(text, "[TZ]", "")
    return F.coalesce(F.when(digits.rlike("^[0-9]{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))).when(digits.rlike("^[0-9]{8}$"), F.try_to_timestamp(digits, F.lit("yyyyMMdd"))), default)


def tokens(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), r"[^a-z0-9\s-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def _windows(words: Column, n: int) -> Column:
    """Arrays of n neighbours. `words` must be a column, not an expression: it is read for each window."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i, n))


def letter_runs(text: Column, longest: int = 5) -> Column:
    """Distinct strings of up to `longest` letters and digits that no letter touches on either side, a letter first."""
    starts = F.regexp_extract_all(text, F.lit(f"(?<![a-z])(?=([a-z][a-z0-9]{{0,{longest}}}))"), F.lit(1))  # and a character more, to see what follows

    def cut(run: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(run)))
        return F.transform(F.filter(sizes, lambda n: ~F.substring(run, n + 1, F.lit(1)).rlike("[a-z]")), lambda n: F.substring(run, F.lit(1), n))

    return F.array_distinct(F.flatten(F.transform(starts, cut)))


def ngrams(words: Column, sizes: Iterable[int] = (2, 3), stop: Iterable[str] = V.STOP_WORDS) -> Column:
    """Distinct n-grams of a column of tokens with some telling one: over two characters, no stop word, no number."""

    def telling(t: Column) -> Column:
        return (F.length(t) > 2) & ~t.isin(*stop) & ~t.rlike("^[0-9]+$")

    def of(n: int) -> Column:
        return F.transform(F.filter(_windows(words, n), lambda g: F.exists(g, telling)), lambda g: F.array_join(g, " "))

    return F.array_distinct(F.concat(*(of(n) for n in sizes)))

"""Scalar column functions: names, domains, dirty cells, ids, quarters, guarded rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes and noise words that do not tell two companies apart.
COMPANY_NOISE = (
    "the", "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "ltd",
    "limited", "plc", "gmbh", "ag", "sa", "bv", "pty", "group", "holdings", "international",
)

# Spellings of yes and no.
TRUE_WORDS = ("1", "true", "yes", "y", "t")
FALSE_WORDS = ("0", "false", "no", "n", "f")

# Subjects of machine replies.
AUTO_REPLY_PATTERNS = ("automatic reply", "out of office", "undeliverable", "delivery status notification")

SAMPLE_FLOOR = 5

# Whatever is no letter, mark or digit of any script parts two words.
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


def norm_company(name: Column) -> Column:
    """Lower-case words of any script without punctuation, legal suffixes and noise words; blank becomes null."""
    words = F.filter(F.split(F.lower(name), NO_WORD), lambda w: (w != "") & ~w.isin(*COMPANY_NOISE))
    key = F.array_join(words, " ")
    return F.when(key != "", key)


def norm_domain(value: Column) -> Column:
    """Host of an address, link or bare domain, without `www.`; blank becomes null."""
    host = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(host, r"[/?#].*$", "")
    host = F.regexp_replace(host, r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":[0-9]+$", ""), r"^www\.", "")
    return F.when(host != "", host)


def parse_mixed_date(text: Column) -> Column:
    """ISO or M/D/YYYY text as a date; anything else is null."""
    t = F.trim(text)
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(t, F.lit("M/d/yyyy"))
    ).cast("date")


def parse_mixed_bool(text: Column) -> Column:
    """Boolean in several spellings; anything else is null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def parse_money(text: Column) -> Column:
    """Amount without currency signs and thousand marks, as decimal(18,2).

    Brackets and a minus on either side are negative. Of comma and point the later one is the decimal mark; a lone comma
    before groups of three digits parts thousands, before one or two digits decimals. Repeated points part thousands. Anything else is null.
    """
    bare = F.regexp_replace(text, r"[^0-9.,()\u2212-]", "")
    negative = bare.rlike(r"^\(.*\)$|^[-\u2212]|[-\u2212]$")
    digits = F.regexp_replace(bare, r"^[-\u2212(]+|[-\u2212)]+$", "")
    plain = (
        F.when(digits.rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?$"), F.replace(digits, F.lit(","), F.lit("")))
        .when(digits.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+,[0-9]*$"), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(digits.rlike(r"^[0-9]{1,3}(\.[0-9]{3}){2,}$"), F.replace(digits, F.lit("."), F.lit("")))
        .when(digits.rlike(r"^[0-9]+,[0-9]{1,2}$"), F.replace(digits, F.lit(","), F.lit(".")))
        .when(digits.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), digits)
    )
    amount = plain.try_cast("decimal(18,2)")
    return F.when(negative, -amount).otherwise(amount).cast("decimal(18,2)")


def norm_record_id(value: Column, form: str = "short") -> Column:
    """Source ids come in a 15- and an 18-character form of the same record; the last three tell which letters are capitals."""
    text = F.trim(value)
    if form == "short":
        return F.when(F.length(text) == 18, F.substring(text, 1, 15)).otherwise(text)
    # Fixed value: the letters that stand for the capitals among five characters, the first counting one.
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"
    marks = []
    for start in (1, 6, 11):
        bits = sum((F.when(F.substring(text, start + i, 1).rlike("[A-Z]"), 1 << i).otherwise(0) for i in range(5)), F.lit(0))
        marks.append(F.substring(F.lit(letters), bits + 1, F.lit(1)))
    return F.when(F.length(text) == 15, F.concat(text, *marks)).otherwise(text)


def format_local_id(prefix: str, width: int, number: Column) -> Column:
    """Prefix plus padded number; a number wider than the pad is kept whole."""
    text = number.cast("string")
    return F.concat(
        F.lit(f"{prefix}-"), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    )


def invert_rate(units_per_base: Column) -> Column:
    """Multiplier to the base currency from a rate quoted as units per base unit."""
    return F.try_divide(F.lit(1).cast("decimal(18,8)"), units_per_base.cast("decimal(18,8)")).cast(
        "decimal(18,8)"
    )


def fiscal_quarter(day: Column, start_month: int = 1) -> Column:
    """First and last day of the fiscal quarter that holds `day`."""
    into = (F.month(day) - F.lit(start_month) + F.lit(12)) % F.lit(3)
    first = F.add_months(F.trunc(day, "month"), -into)
    return F.struct(first.alias("start"), F.date_sub(F.add_months(first, 3), 1).alias("end"))


def days_to(target: Column, as_of: Column) -> Column:
    """Days until `target`; negative when it has passed."""
    return F.datediff(target, as_of)


def days_overdue(target: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, target), F.lit(0))


def whole_months_since(day: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, day)).cast("int")


def split_list(text: Column) -> Column:
    """Semicolon list as a trimmed array; a blank cell is null and not an empty list."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def list_permits(allowed: Column, value: Column) -> Column:
    """Membership where a blank list puts no constraint."""
    return allowed.isNull() | F.coalesce(F.array_contains(allowed, value), F.lit(False))


def auto_reply_match(subject: Column, patterns: Sequence[str] = AUTO_REPLY_PATTERNS) -> Column:
    return F.lower(subject).rlike("|".join(patterns))


def word_tokens(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != ""))


def alias_match(text: Column, aliases: Column) -> Column:
    """True when any alias occurs in the text as a word sequence, in any case."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), NO_WORD, " "), F.lit(" "))
    return F.exists(
        aliases,
        lambda a: F.contains(
            padded, F.concat(F.lit(" "), F.regexp_replace(F.lower(a), NO_WORD, " "), F.lit(" "))
        ),
    )


def guarded_rate(part: Column, whole: Column, floor: int = SAMPLE_FLOOR) -> Column:
    """Ratio from a large enough sample, else null."""
    return F.when(whole >= floor, F.try_divide(part.cast("double"), whole.cast("double")))


def sample_note(part: Column, whole: Column, floor: int = SAMPLE_FLOOR) -> Column:
    """Counts as text where the rate is withheld."""
    return F.when(whole < floor, F.concat_ws(" of ", part.cast("string"), whole.cast("string")))


def reason_text(name: Column, cause: str, number: Column, unit: str = "") -> Column:
    """One line naming the record, the cause and the number."""
    return F.concat_ws(
        "", name.cast("string"), F.lit(f" - {cause} "), number.cast("string"), F.lit(f" {unit}" if unit else "")
    )


def account_slug(day: Column, account: Column) -> Column:
    slug = F.regexp_replace(F.lower(account), NO_WORD, "-")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), F.regexp_replace(slug, r"^-+|-+$", ""))


def json_extract(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def flag_list(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in the given order (a null condition does not hold)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))

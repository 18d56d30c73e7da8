"""Date texts: free text to a timestamp text, stored timestamps to what readers see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, col, filled

#: What may stand before a date, and the months of mail dates.
PREFIXES = ("cập nhật", "đăng lúc", "ngày đăng", "published", "posted")
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

#: Parts of the patterns. A zone remark may follow a moment, or stand between day and clock; it is read over, never applied.
LABEL = rf"(?i)^(?:{'|'.join(PREFIXES)})\s*:?\s*"
TWO, SECONDS = "([0-9]{1,2})", "(?::([0-9]{2}))?"
REMARK = r"\s*\(?\s*(?:GMT|UTC)\s*[+-]?\s*[0-9:]*\s*\)?"
ISO = rf"(?i)^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:[^0-9]([0-9]{{2}})(?::?([0-9]{{2}})(?::?([0-9]{{2}})(?:[.,][0-9]+)?)?)?(?:Z|[+-][0-9:]{{4,9}})?)?(?:{REMARK})?$"
MAIL = rf"(?i)^(?:[a-z]{{3,9}},?\s+)?{TWO}[\s-]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s-]+([0-9]{{4}})\s+{TWO}:([0-9]{{2}}){SECONDS}(?:\s+\S+)*$"
LOCAL = rf"(?i){TWO}[/-]{TWO}[/-]([0-9]{{4}})(?:(?:{REMARK})?[\s,]+(?:lúc\s*)?{TWO}[h:]([0-9]{{2}}){SECONDS})?"


def _stamp(year: Column, month: Column, day: Column, *clock: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' of texts, missing clock parts as zero; NULL where there is no such moment."""
    two = [F.lpad(x, 2, "0") for x in (month, day, *clock)]
    text = F.concat(year, F.lit("-"), two[0], F.lit("-"), two[1], F.lit(" "), two[2], F.lit(":"), two[3], F.lit(":"), two[4])
    return F.when((year != "") & (year != "0000") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), text)


def parse_datetime_text(c: Column | str) -> Column:
    """ISO, else mail, else day/month/year text as 'yyyy-MM-dd HH:mm:ss'; '' where none fits. Offsets are dropped, not applied."""
    text = clean(F.regexp_replace(F.regexp_replace(clean(c), LABEL.replace("(?i)", "(?iu)"), ""), "^[ \\-|,]+|[ \\-|,]+$", ""))
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    iso = _stamp(*(part(ISO, i) for i in range(1, 7)))
    month = F.when(part(MAIL, 2) == "", "").otherwise(((F.position(F.lower(part(MAIL, 2)), F.lit(MONTHS.lower())) + 2) / 3).cast("int").cast("string"))
    mail = _stamp(part(MAIL, 3), month, part(MAIL, 1), *(part(MAIL, i) for i in (4, 5, 6)))
    local = _stamp(part(LOCAL, 3), part(LOCAL, 2), part(LOCAL, 1), *(part(LOCAL, i) for i in (4, 5, 6)))
    return F.coalesce(iso, mail, local, F.lit(""))


CLOCK = r"(?:\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$"
YEAR_FIRST = (r"^(\d{4})-(\d{1,2})-(\d{1,2})" + CLOCK, r"^(\d{4})/(\d{1,2})/(\d{1,2})" + CLOCK)
DAY_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4})" + CLOCK


def format_published(*dates: Column | str) -> Column:
    """The first date that is not blank as dd/mm/yyyy [HH:MM]; the text itself where its format is unknown."""
    raw = F.coalesce(*(filled(F.trim(col(c))) for c in dates), F.lit(""))
    text = F.trim(F.replace(F.replace(raw, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")))
    text = F.trim(F.split_part(text, F.lit("+"), F.lit(1)))
    options = []
    for pattern, (y, m, d) in ((YEAR_FIRST[0], (1, 2, 3)), (YEAR_FIRST[1], (1, 2, 3)), (DAY_FIRST, (3, 2, 1))):
        part = lambda i, p=pattern: F.regexp_extract(text, p, i)
        stamp = _stamp(part(y), part(m), part(d), part(4), part(5), part(6))
        day = F.concat(F.substring(stamp, 9, 2), F.lit("/"), F.substring(stamp, 6, 2), F.lit("/"), F.substring(stamp, 1, 4))
        options.append(F.when(part(4) == "", day).otherwise(F.concat(day, F.lit(" "), F.substring(stamp, 12, 5))))
    return F.coalesce(*options, raw)


def next_run_at(now: Column | str, schedule: str = "07:00") -> Column:
    """The next daily run after `now` ('yyyy-MM-dd HH:mm:ss'); a schedule that is no clock time means 07:00."""
    hour, _, minute = schedule.partition(":")
    ok = hour.strip().isdigit() and minute.strip().isdigit() and int(hour) <= 23 and int(minute) <= 59
    clock = f" {int(hour):02d}:{int(minute):02d}:00" if ok else " 07:00:00"
    today = F.concat(F.substring(col(now), 1, 10), F.lit(clock))
    later = F.concat(F.date_add(F.to_date(F.substring(col(now), 1, 10)), 1).cast("string"), F.lit(clock))
    return F.when(today > col(now), today).otherwise(later)

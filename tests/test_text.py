"""Text functions on hand-written records."""

from pyspark.sql import functions as F

from accord.functions import text as T

LINE = "x (A) call the bank +home @phone due:2024-05-01"
ICS = "BEGIN:VCALENDAR\nBEGIN:VTIMEZONE\nEND:VTIMEZONE\nBEGIN:VEVENT\nDTSTAMP:20240102T030405Z\nSUMMARY;LANGUAGE=en:Lunch\nEND:VEVENT"


def path_hash(path):
    """Bytes signed; each string, then the path, as a polynomial modulo 256."""
    total = 0
    for text in path:
        own = 0
        for byte in text.encode():
            own = (own * 19 + (byte - 256 if byte > 127 else byte)) % 256
        total = (total * 199 + own) % 256
    return f"{total:02x}"


def test_text_functions(spark):
    one = F.lit
    cases = {
        "empty_hash": (T.sha256_hex(one("")), ""),
        "identity": (T.decompose_identity(one("u\x012024-01-02T03:04:05Z"))["uid"], "u"),
        "bad_identity": (T.decompose_identity(one("u\x01never"))["uid"], ""),
        "literal": (T.ical_literal(one(ICS), "SUMMARY"), "Lunch"),
        "stamp": (F.date_format(T.ical_timestamp(one(ICS)), "yyyy-MM-dd HH:mm:ss"), "2024-01-02 03:04:05"),
        "no_stamp": (T.ical_timestamp(one("BEGIN:VEVENT")).isNull(), True),
        "stripped": (T.strip_line(one("A:1\nB;x=y:2\nC:3"), "B"), "A:1\nC:3"),
        "kind": (T.component_kind(one(ICS)), "VEVENT"),
        "rule": (T.rrule_parts(one("RRULE:freq=DAILY;count=3"))["FREQ"], "DAILY"),
        "plain": (T.is_complex_recurrence(F.array(one("RRULE:FREQ=DAILY"))), False),
        "by": (T.is_complex_recurrence(F.array(one("RRULE:FREQ=WEEKLY;BYDAY=MO"))), True),
        "excluded": (T.is_complex_recurrence(F.array(one("RRULE:FREQ=DAILY"), one("EXDATE:20240101"))), True),
        "task": (T.parse_todotxt(one(LINE))["summary"], "call the bank"),
        "task_tags": (F.array_join(T.parse_todotxt(one(LINE))["categories"], ","), "+home,@phone"),
        "task_due": (T.parse_todotxt(one(LINE))["due"], "2024-05-01"),
        "task_priority": (T.parse_todotxt(one(LINE))["priority"], "A"),
        "task_line": (T.to_todotxt(one(True), one("A"), one("2024-05-01"), F.array(one("@phone"), one("home")), one("call")), "x (A) call due:2024-05-01 @phone"),
        "note": (T.parse_markdown(one("---\nid: n1\n---\nBody\n\n"))["body"], "Body\n"),
        "note_id": (T.parse_markdown(one("---\nid: n1\n---\nBody\n\n"))["id"], "n1"),
        "open_fence": (T.parse_markdown(one("---\nid: n1\nBody"))["body"], "---\nid: n1\nBody\n"),
        "carrier": (T.carrier_key(one("busyStatus"), "x-"), "x-busy-status"),
        "property": (T.property_from_carrier(one("x-busy-status"), "x-"), "busyStatus"),
        "css": (T.css_to_argb(one("#11223380")), "#80112233"),
        "argb": (T.argb_to_css(one("#80112233")), "#11223380"),
        "calendar": (T.calendar_id(one("My Wörk_1 #")), "my-wörk_1-"),
        "no_calendar": (T.calendar_id(one("#!")), "calendar"),
        "slug": (T.slug(one("Été-a_b  c.d")), "été-a-b--cd"),
        "no_slug": (T.slug(one("...")), "record"),
        "dav": (T.dav_slug(one("https://example.com/calendars/a%20b+c/?x")), "a b+c"),
        "no_dav": (T.dav_slug(one("https://example.com/")), ""),
        "start_relative": (T.alarm_form(one('{"offset":-900}')), "start_relative"),
        "end_relative": (T.alarm_form(one('{"offset":0,"related":"end"}')), "end_relative"),
        "absolute": (T.alarm_form(one('{"at":"2024-01-01T00:00:00Z","offset":0}')), "absolute"),
        "malformed": (T.alarm_form(one('{"related":"end"}')), "malformed"),
        "info": (T.path_bucket(F.array(one("info"))), "info"),
        "bucket": (T.path_bucket(F.array(one("é"), one("a"))), path_hash(["é", "a"])),
        "simple": (T.simplify_recurrence(F.array(one("RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=MO;UNTIL=20250101"))), "RRULE:FREQ=WEEKLY;INTERVAL=2;UNTIL=20250101"),
        "no_rule": (T.simplify_recurrence(F.array(one("EXDATE:20240101"))).isNull(), True),
        "markdown": (T.to_markdown(one("t: x\n"), one("n1"), one("Body\n\n")), "---\nid: n1\nt: x\n---\nBody\n"),
        "bare_markdown": (T.to_markdown(one(None).cast("string"), one(None).cast("string"), one("Body")), "Body\n"),
    }
    row = spark.range(1).select(*(c.alias(k) for k, (c, _) in cases.items())).first().asDict()
    assert row == {k: v for k, (_, v) in cases.items()}

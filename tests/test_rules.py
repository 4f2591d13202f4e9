"""Address rules, variables, secrets and loop texts: cases with known answers."""

import pytest
from pyspark.sql import functions as F

from trailsift.functions import text as tx
from trailsift.functions import trace as tr
from trailsift.functions import urls as u
from trailsift.operators import rules as ru


def ask(spark, build, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "pattern", "expected"),
    [
        ("https://example.com/x", "example.com", True), ("https://www.example.com", "example.com", True),
        ("https://sub.example.com", "example.com", False), ("https://sub.example.com", "*.example.com", True),
        ("https://example.com", "*.example.com", True), ("https://notexample.com", "*.example.com", False),
        ("ftp://a.example.com", "*.example.com", False), ("https://example.com@evil.org", "example.com", False),
        ("https://a.com/path/x", "https://a.com/path", True), ("http://a.com/path", "https://a.com", False),
        ("brave://settings", "brave://*", True), ("https://wiki.org", "*.org", True), ("https://EXAMPLE.com", "Example.COM", True),
        ("https://api.v1.host.net", "api.*.host.net", True), ("https://www.sub.example.co", "sub.example.co", False),
    ],
)
def test_list_rules(spark, url, pattern, expected):
    assert ask(spark, lambda c: u.rules_match(c, [pattern]), url) is expected


@pytest.mark.parametrize(
    ("url", "pattern", "expected"),
    [
        ("https://example.com", "example.com", True), ("http://example.com", "example.com", False), ("http://example.com", "http*://example.com", True),
        ("https://a.google.com", "*.google.com", True), ("https://google.com", "*.google.com", True), ("https://evilgoogle.com", "*.google.com", False),
        ("https://example.com", "example.*", False), ("https://a.b.example.com", "*.*.example.com", False), ("https://x.com", "*", True),
        ("about:blank", "*", False), ("https://example.com:8443", "example.com:443", True), ("chrome-extension://abc", "chrome-extension://*", True),
        ("https://good.com@evil.com", "good.com", False), ("not a url", "*", False),
    ],
)
def test_strict_patterns(spark, url, pattern, expected):
    assert ask(spark, lambda c: u.domain_pattern_match(c, pattern), url) is expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://180.1.1.1/x", False), ("http://[::1]/", False), ("https://example.com", True), ("about:blank", True),
        ("data:text/html,x", True), ("https://1.2.3.4.5/", True), ("https://256.1.1.1", True), ("nonsense", False),
    ],
)
def test_ip_block(spark, url, expected):
    assert ask(spark, lambda c: ru.policy(c, block_ip=True), url) is expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://cdn.example.org/a.jpg", True), ("ftp://x.org/a", False), ("http://localhost/a", False), ("http://a.internal/a", False), ("http://172.16.0.1/", False),
        ("http://172.32.0.1/", True), ("http://[fe80::1]/x", False), ("http://[2606:4700::1]/x", True), ("http://169.254.1.1/", False), ("http:///x", False),
    ],
)
def test_public_images(spark, url, expected):
    assert ask(spark, u.public_image_url, url) is expected


@pytest.mark.parametrize(
    ("value", "kind", "hint", "expected"),
    [
        ("a@b.co", "", "", ("email", "email")), ("x", "email", "", ("email", "email")), ("+1 (555) 123-4567", "", "", ("phone", "phone")),
        ("555-1234", "", "", None), ("2024-01-31", "", "", ("date", "date")), ("John", "", "", ("first_name", None)),
        ("John Smith", "", "", ("full_name", None)), ("12345", "", "", ("number", "number")), ("x", "", "shipping address", ("shipping_address", None)),
        ("x", "", "Last Name", ("last_name", None)), ("x", "", "postcode", ("zip_code", "postal_code")), ("john", "", "", None),
    ],
)
def test_variables(spark, value, kind, hint, expected):
    got = ask(spark, lambda v, k, h: tr.detect_variable(v, F.create_map(F.lit("type"), k, F.lit("id"), h)), value, kind, hint)
    assert (tuple(got) if got else None) == expected


def test_search_words_ignore_order_case_and_marks(spark):
    a = ask(spark, tr.action_hash, "search", '{"query": "Site:Temple, OLD gate"}')
    assert a == ask(spark, tr.action_hash, "search", '{"query": "gate old   site temple!"}')
    assert a != ask(spark, tr.action_hash, "search", '{"query": "gate old temple"}')
    assert ask(spark, tr.normalize_action, "custom", '{"b": 1, "a": "x", "c": null}') == 'custom|{"a": "x", "b": 1}'
    assert ask(spark, tr.normalize_action, "scroll", '{"down": false, "index": 3}') == "scroll|up|3"


def test_think_and_urls(spark):
    assert ask(spark, tx.strip_think, "<think>a\nb</think> yes") == "yes"
    assert ask(spark, tx.strip_think, "lost</think> left </think>end") == "end"
    long = "see https://h.org/p?" + "q" * 60 + "#f now"
    short = ask(spark, lambda c: tr.shorten_urls(c, 25)[0], long)
    assert short.startswith("see https://h.org/p?" + "q" * 24 + "...") and short.endswith(" now") and len(short) < len(long)
    assert ask(spark, tr.single_url, "go to example.com please") == "https://example.com"
    assert ask(spark, tr.single_url, "never open https://example.com") is None
    assert ask(spark, tr.single_url, "a.org and b.org") is None
    assert ask(spark, tr.single_url, "read report.pdf, write to me@x.org, see https://x.org/a).") == "https://x.org/a"


def test_secrets(spark):
    assert ask(spark, lambda c: tr.mask_secrets(c, [("a", "s1"), ("b", ""), ("c", "s2")]), "s1 s2") == "<secret>a</secret> <secret>c</secret>"
    scoped = [("https://*.x.org", "k", "v"), (None, "g", "w")]
    assert ask(spark, lambda t, c: tr.unmask_secrets(t, c, scoped), "<secret>k</secret>/<secret>g</secret>", "https://a.x.org") == "v/w"
    assert ask(spark, lambda t, c: tr.unmask_secrets(t, c, scoped), "<secret>k</secret>", "http://a.x.org") == "<secret>k</secret>"
    assert ask(spark, lambda t, c: tr.unmask_secrets(t, c, scoped), "g", "https://y.org") == "w"


def test_names(spark):
    name = lambda t, s: ask(spark, lambda a, b: tx.final_file_name(a, b.cast("bigint"), F.lit("abcdef0123"), F.lit(".JPE")), t, s)
    assert name("temple_012_Gate", "7") == "007_Gate_abcdef01.jpg"
    assert name("Gate_1234", "7") == "Gate_1234_abcdef01.jpg"
    assert name("", "1234") == "1234_abcdef01.jpg" or name("", "1234").endswith("_abcdef01.jpg")
    assert ask(spark, lambda c: tx.renumber_title(c, F.lit(1000)), "china_temple_012_gate") == "china_temple_1000_gate"
    assert ask(spark, tx.sequence_from_name, "hall_0042_x.png") == 42
    assert ask(spark, tx.markdown_cell, " a|b\r\nc  d ") == "a\\|b c d"

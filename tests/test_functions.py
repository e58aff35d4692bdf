import pytest
from pyspark.sql import functions as F

from colophon.functions import entities, json_repair, pricing, quality, similarity, terms, text


@pytest.mark.parametrize(("given", "expected"), [("a  b\tc", "a b c"), ("a\n\n\n\nb", "a\n\nb"), ("a\n\nb", "a\n\nb"), ("", "")])
def test_clean_ocr(one, given, expected):
    assert one(text.clean_ocr, given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [("École  Polytechnique!", "ecole polytechnique"), ("World War 1", "world war"), ("Москва", ""), ("ﬁne", "fine"), (None, ""), ("  A\tB ", "a b")],
)
def test_comparison_key(one, given, expected):
    assert one(text.comparison_key, given) in (expected, None if given is None else expected)
    assert text.comparison_key_of(given) == expected


def test_native_key_equals_batch_key_on_latin(one):
    for s in ("Çà et là, Ünïcode", "straße", "x  y", "ÿ ñ õ"):
        assert one(text.latin_key, s) == text.comparison_key_of(s)


def test_wide_key_keeps_what_the_plain_one_drops(one):
    assert one(text.wide_key, "World War 1") != one(text.wide_key, "World War 2")
    assert one(text.wide_key, "Москва, 1917!") == "москва 1917"


@pytest.mark.parametrize(("given", "expected"), [("History, Art; Music", ["History", "Art", "Music"]), (None, []), (" ,;", []), ("one", ["one"])])
def test_split_list(one, given, expected):
    assert one(text.split_list, given) == expected


@pytest.mark.parametrize(("given", "expected"), [("  Big   Label. ", "big label"), ("x..", "x."), (None, "")])
def test_matching_label(one, given, expected):
    assert one(text.matching_label, given) == expected


@pytest.mark.parametrize(("a", "b", "expected"), [("Modern Art", "art history", True), ("a b", "c d", False), (None, "x", False), ("artful", "art", False)])
def test_word_overlap(one, a, b, expected):
    assert one(text.word_overlap, a, b) is expected


@pytest.mark.parametrize(("given", "expected"), [("Baltimore--Maryland (City)", "Baltimore--Maryland"), ("(only)", "(only)"), ("plain", "plain"), ("a (b) c", "a (b) c"), ("a (b) (c)", "a (b)")])
def test_search_term(one, given, expected):
    assert one(text.search_term, given) == expected


def test_truncate(one):
    assert one(lambda c: text.truncate(c, 5), "abcdefgh") == "abcde"
    assert one(lambda c: text.truncate(c, 20), "a" * 30) == "aa\n[...truncated...]"
    assert one(lambda c: text.truncate(c, 30), "a" * 30) == "a" * 30
    with pytest.raises(ValueError):
        text.truncate(F.lit("x"), -1)


def test_fill_template_does_not_read_values_again(spark, one):
    assert one(lambda a: text.fill_template("$$1 for $x and ${x}!", x=a), "$y\\1") == "$1 for $y\\1 and $y\\1!"
    with pytest.raises(ValueError, match="missing"):
        text.fill_template("$nope", x=F.lit("a"))
    with pytest.raises(ValueError, match="single"):
        text.fill_template("5$ ", x=F.lit("a"))


@pytest.mark.parametrize(("a", "b", "expected"), [("Jon Smith", "John Smith", 94.737), ("abc", "abc", 100.0), ("abc", "xyz", 0.0), ("", "", 100.0), ("", "a", 0.0), ("kitten", "sitting", 61.538)])
def test_ratio_native_equals_fast(one, a, b, expected):
    assert round(one(similarity.ratio, a, b), 3) == expected
    assert round(one(similarity.fast_ratio, a, b), 3) == expected


@pytest.mark.parametrize(
    ("given", "name", "kind"),
    [
        ("John F. Staub (Architect)", "John F. Staub", "architect"),
        ("University of Texas", "University of Texas", "institution"),
        ("Acme Corp.", "Acme Corp.", "organization"),
        ("the cohort study", "the cohort study", "project"),
        ("J. K. Rowling", "J. K. Rowling", "person"),
        ("Mary Smith", "Mary Smith", "person"),
        ("harris county", "harris county", "location"),
        ("thing", "thing", "unknown"),
        (" x (y) (z) ", "x (y)", "z"),
    ],
)
def test_parsed(one, given, name, kind):
    assert tuple(one(entities.parsed, given)) == (name, kind)


@pytest.mark.parametrize(("given", "expected"), [(" A &  B ", "A and B"), ("Acme Co.", "Acme Co."), ("Co.x", "Companyx"), ("Inc.y", "Incorporatedy")])
def test_normalised_name(one, given, expected):
    assert one(entities.normalised_name, given) == expected


@pytest.mark.parametrize(
    ("raw", "done", "expected"),
    [
        ("", True, quality.EMPTY),
        (" \n", True, quality.EMPTY),
        ("Processing error: x", True, quality.EXPLICIT),
        ("no braces in this text", True, quality.BROKEN),
        ("short", True, None),
        ("{}" + " word" * 600, True, quality.REPETITION),
        ("{" * 20 + "a b c d e f g h", True, quality.BROKEN),
        ("." * 3000 + "{}", True, quality.BROKEN),
        ('{"title": "fine and long enough"}', False, quality.MISSING),
        ('{"title": "fine and long enough"}', True, None),
    ],
)
def test_failure_reason(one, raw, done, expected):
    assert one(lambda r: quality.failure_reason(F.lit(True), r, F.lit(done)), raw) == expected


def test_no_analysis_comes_first(one):
    assert one(lambda r: quality.failure_reason(F.lit(False), r, F.lit(True)), "Error: x") == quality.NO_ANALYSIS


def test_dominance(one):
    assert one(quality.dominance, "aab \n") == 0.4
    assert one(quality.dominance, "") == 0.0
    assert one(quality.top_character, " \n\t") == 0
    assert one(quality.longest_word_run, "a b b b a") == 3


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('{"a": "b"}', {"a": "b"}),
        ('```json\n{"a": "b",}\n```', {"a": "b"}),
        ('Sure: {"a": "b"} done', {"a": "b"}),
        ('{"a": "b"} and {"c": "d"}', {"a": "b"}),
        ("{a: b, c: d}", {"a": "b", "c": "d"}),
        ("{}", {}),
        ("[1]", None),
        ("nothing", None),
        ("", None),
        (None, None),
    ],
)
def test_repaired(one, raw, expected):
    assert one(json_repair.repaired, raw) == expected


def test_record(one):
    got = one(lambda r: json_repair.record(json_repair.repaired(r)), '{"title": " T ", "topics": "a, b,", "namedEntities": ["x", "Ann", "Ann"], "contentWarning": "violence.."}')
    assert (got.title, got.creator, got.subjects, got.named_entities, got.geographic_entities, got.content_warning) == ("T", None, ["a", "b"], ["Ann"], [], "Violence.")


def test_first_subject_name_that_is_there_counts(one):
    assert one(lambda r: json_repair.subject_list(json_repair.repaired(r)), '{"subjects": [], "topics": ["a"]}') == []


def test_joined_warning(one):
    split = lambda c: json_repair.joined_warning(F.filter(F.split(c, "/"), lambda x: x != ""))
    assert one(split, "racism./ war ") == "Racism; war."
    assert one(split, "") == "None"


@pytest.mark.parametrize(("raw", "expected"), [('{"selected_terms": ["a", {"label": "b"}]}', ["a", "b"]), ('{"selected_terms": []}', []), ('{"x": 1}', None), ('{"selected_terms": [{"x": 1}]}', None)])
def test_selected_labels(one, raw, expected):
    assert one(json_repair.selected_labels, raw) == expected


def test_terms_cells_round_trip(one):
    cell = "Art; modern (http://x/1) [Getty AAT]; Music [LCSH]"
    back = one(terms.from_cell, cell)
    assert [(t.label, t.uri, t.source) for t in back] == [("Art; modern", "http://x/1", "Getty AAT"), ("Music", "", "LCSH")]
    assert one(lambda c: terms.cell(terms.from_cell(c)), cell) == cell


def test_fast_payload(one):
    payload = '{"response": {"docs": [{"suggestall": ["Art"], "idroot": ["fst1"], "auth": "Art, Modern", "type": "auth"}, {"suggestall": "No id"}, {"suggestall": "Music", "idroot": "fst2"}]}}'
    got = one(terms.fast_terms, payload)
    assert [(t.label, t.uri) for t in got] == [("Art, Modern", "http://id.worldcat.org/fast/fst1"), ("Music", "http://id.worldcat.org/fast/fst2")]
    assert one(terms.fast_terms, "{}") == []


def test_lcsh_and_getty_payloads(one):
    assert [t.label for t in one(terms.lcsh_terms, '{"hits": [{"aLabel": "A", "uri": "u"}, {"aLabel": "", "uri": "v"}]}')] == ["A"]
    xml = "<Vocabulary><Subject><Preferred_Term>Lofts</Preferred_Term><Subject_ID>30</Subject_ID></Subject><Subject><Subject_ID>31</Subject_ID></Subject></Vocabulary>"
    got = one(lambda c: terms.getty_terms(c, "Getty AAT"), xml)
    assert [(t.label, t.uri) for t in got] == [("Lofts", "http://vocab.getty.edu/aat/30")]


def test_distinct_by_uri_keeps_terms_without_one(one):
    got = one(lambda c: terms.distinct_by_uri(terms.from_cell(c)), "A (u) [X]; B (u) [X]; C [X]; D [X]")
    assert [t.label for t in got] == ["A", "C", "D"]


def test_prompt_block(one):
    assert one(lambda c: terms.prompt_block(F.lit("S"), terms.from_cell(c)), "A (u) [X]") == "Subject: S\n  - A (u) [X]\n"
    assert "No candidate" in one(lambda c: terms.prompt_block(F.lit("S"), terms.from_cell(c)), "")


def test_costs(spark):
    rows = [("gpt-4o", 1000, 1000, 400, False), ("gpt-4o", 1000, 1000, 400, True), ("nope", 1, 1, 0, False)]
    usage = spark.createDataFrame(rows, "model string, prompt long, completion long, cached long, batch boolean")
    got = [r.cost for r in pricing.with_cost(usage, pricing.price_table(spark)).orderBy("model", "batch").collect()]
    assert got[0] == pytest.approx(0.6 * 0.0025 + 0.01 + 0.4 * 0.00125)
    assert got[1] == pytest.approx(got[0] / 2)
    assert got[2] is None


def test_request_errors(one):
    ask = lambda c: json_repair.request_errors(F.lit("m"), F.array(F.struct(F.lit("tool").alias("role"), c.alias("content"))), F.lit(0), F.lit(3))
    assert one(ask, " ") == ["invalid role", "empty content", "max_tokens must be positive", "temperature must be within 0 and 2"]

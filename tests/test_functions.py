import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tracehold import conventions as cv
from tracehold.functions import otel, sql, text
from tracehold.functions.numeric import exact_sum, money, round_half_away
from tracehold.schemas import ATTRS, KEY_VALUE
from tracehold.sources.dims import read_erasure


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def attrs(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).cast("string").alias("v")) for k, v in pairs]).cast(ATTRS)


def test_decode(spark):
    j = F.from_json(F.lit('[{"key":"a","value":{"stringValue":"x"}},{"key":"a","value":{"intValue":5}},'
                          '{"key":"b","value":{"arrayValue":{"values":[{"stringValue":"q"}]}}},{"key":"c"}]'), KEY_VALUE)
    row = one(spark, l=otel.otel_attrs(j), n=otel.otel_attrs(F.lit(None).cast(KEY_VALUE)),
              first=otel.attr(otel.otel_attrs(j), "a"), none=otel.attr(otel.otel_attrs(j), "zz"))
    assert [(a.k, a.v) for a in row["l"]] == [("a", "x"), ("a", "5"), ("b", '{"values":[{"stringValue":"q"}]}'), ("c", None)]
    assert row["n"] == [] and row["first"] == "x" and row["none"] is None


def test_numbers_and_times(spark):
    row = one(spark, t=otel.otel_time(F.lit('"1759699800123456789"')), zero=otel.otel_time(F.lit("0")),
              bad=otel.otel_time(F.lit("soon")), neg=otel.otel_time(F.lit("-5")), tiny=otel.otel_time(F.lit("5")),
              far=otel.otel_time(F.lit("9300000000000000000")), num=otel.otel_num(F.lit('"1.5"')),
              dur=otel.span_duration_ms(F.lit("1000000"), F.lit('"91000000"')))
    assert row["t"] == dt.datetime(2025, 10, 5, 21, 30, 0, 123456)
    assert row["zero"] is None and row["bad"] is None and row["neg"] is None
    assert row["tiny"] == dt.datetime(1970, 1, 1)
    assert row["far"].year == 2264 and row["num"] == 1.5 and row["dur"] == 90.0


@pytest.mark.parametrize("f,value,want", [
    (otel.otel_kind, "2", "server"), (otel.otel_kind, "SPAN_KIND_CONSUMER", "consumer"), (otel.otel_kind, "9", "unspecified"),
    (otel.otel_status, '"1"', "ok"), (otel.otel_status, "STATUS_CODE_ERROR", "error"), (otel.otel_status, "", "unset"),
    (otel.otel_temporality, "2", "cumulative"), (otel.otel_temporality, "0", None)])
def test_enums(spark, f, value, want):
    assert one(spark, v=f(F.lit(value)))["v"] == want


def test_labels(spark):
    p = cv.LABEL_PREFIX
    m = otel.labels_of(attrs((p + "team", "a"), (p + "team", "b"), (p, "x"), (p + "kind", None), ("other", "z"), (p + "env", "prod")))
    row = one(spark, m=m, both=otel.labels_match(m, ["team:a", "env:prod"]), no=otel.labels_match(m, ["team:b"]),
              all=otel.labels_match(m, []), col=otel.labels_match(m, F.lit("team:a\x1fenv:prod")),
              null=otel.labels_match(F.lit(None).cast("map<string,string>"), ["a:b"]))
    assert row["m"] == {"team": "a", "env": "prod"}
    assert row["both"] and row["all"] and row["col"] and not row["no"] and row["null"] is False


def test_mask(spark):
    l = attrs(("user.name", "bob"), ("x", "bob"), ("user.name", "al"))
    row = one(spark, m=otel.mask_attrs(l, ["bob"]), h=otel.holds_erased(l, attrs(), ["bob"]), n=otel.holds_erased(attrs(), l, ["eve"]))
    assert [a.v for a in row["m"]] == [cv.ERASED, "bob", "al"] and row["h"] and not row["n"]


def test_text_rules(spark):
    key = bytes(range(32))
    want = hmac.new(key, cv.ACCOUNT_KEY_LABEL.encode(), hashlib.sha256).hexdigest()[:8] + ":" + hmac.new(key, b"u1", hashlib.sha256).hexdigest()
    row = one(spark, h=text.account_hash(F.lit("u1"), key), e=text.is_email(F.lit("a.b@c.example.org")),
              s=text.is_email(F.lit("mail a@b.org now")), u=text.under_home(F.lit("/home/al/x"), "/home//al/"),
              l=text.under_home(F.lit("/home/alan"), "/home/al"), r=text.under_home(F.lit("/x"), "/"),
              src=text.source_name(F.lit("runs/r1/a.1.open.jsonl")), ex=text.excerpt(F.lit("  a \n b ")),
              kinds=text.canary_kinds(F.lit("x @canary:prompt @canary:secret")),
              planted=text.plant_canaries(F.lit("a @canary:prompt b @canary:other"), {"prompt": "p$1\\"}),
              v=text.registry_version(F.lit("0.3.0+1d")), ulid=text.id_like(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV")),
              low=text.id_like(F.lit("01arz3ndektsv4rrffq69g5fav")), item=text.id_like(F.lit("AB-12")))
    assert row["h"] == want and row["e"] and not row["s"] and row["u"] and not row["l"] and not row["r"]
    assert row["src"] == "runs.r1.a.1" and row["ex"] == "a b" and row["kinds"] == ["prompt", "secret"]
    assert row["planted"] == "a p$1\\ b " and row["v"] == "0.3.0"
    assert row["ulid"] == "a ULID" and row["low"] is None and row["item"] == "an item key"


def test_labels_argument(spark):
    text.check_label("team:a/b")
    for bad in ("team", "Team:a", "team:/a", "team:", "team:" + "x" * 65):
        with pytest.raises(ValueError):
            text.check_label(bad)
        assert not one(spark, v=text.valid_label(F.lit(bad)))["v"]
    assert one(spark, v=text.valid_label(F.lit("team:a:b")))["v"] is False


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (2.675,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(round_half_away(F.col("x"), 2)).collect()] == [1.0, 0.28, 2.68, -1.5]
    df = spark.createDataFrame([(0.1,)] * 10 + [(0.00005,)], "x double")
    assert df.select(money(exact_sum(F.col("x")))).first()[0] == 1.0001


def test_sql_functions(spark):
    assert len(sql.register(spark, ["bob"])) == 15
    row = spark.sql("""SELECT otel_kind('3') k, otel_time('1000000000') t, labels_match(map('a','b'), 'a:b') m,
        attr(array(named_struct('k','x','v','1')), 'x') a, erased('bob') e,
        mask_attrs(array(named_struct('k','user.name','v','bob')))[0].v masked,
        labels_of(array(named_struct('k','%steam','v','r'))) l""" % cv.LABEL_PREFIX).first()
    assert (row.k, row.m, row.a, row.e, row.masked, row.l) == ("client", True, "1", True, cv.ERASED, {"team": "r"})


def test_sums_of_any_size(spark):
    """Tiny, huge and non-finite values count; plain ones are exact in any order; whole numbers do not overflow on the way."""
    from tracehold.functions.numeric import full_sum, whole_sum
    total = lambda values: spark.createDataFrame([(v,) for v in values], "x double").select(full_sum(F.col("x"))).first()[0]
    assert total([3e-10] * 10 + [None]) == pytest.approx(3e-9, rel=1e-12) and total([1e30, 1e30]) == 2e30
    assert total([0.1] * 10) == 1.0 and total([]) is None and total([None]) is None
    assert total([1e30, 0.1, -1e30]) == pytest.approx(0.1) and total([float("inf"), 1.0]) == float("inf")
    whole = lambda values: spark.createDataFrame([(v,) for v in values], "x string").select(whole_sum(F.col("x"))).first()[0]
    top = str((1 << 63) - 1)
    assert whole([top, "1", "-1"]) == (1 << 63) - 1 and whole([top, "1"]) is None and whole(["x", "2"]) == 2


def test_shared_folder_is_asked_for_off_local_mode():
    from tracehold.session import shared_dir

    class Nothing:
        def isDefined(self):
            return False

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: Nothing()})())
    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_an_erasure_list_is_refused_or_whole(spark, tmp_path):
    path = tmp_path / "erased.txt"
    path.write_text("# people\nbob\n\n  alice \nbob\neve\n")
    assert read_erasure(spark, str(path)) == read_erasure(spark, str(path), most=None) == ["alice", "bob", "eve"]
    assert read_erasure(spark, str(path), most=3) == ["alice", "bob", "eve"]  # a handle that repeats counts once
    with pytest.raises(ValueError):
        read_erasure(spark, str(path), most=2)
    path.write_text("".join(f"person-{i}\n" for i in range(12_000)))
    with pytest.raises(ValueError):
        read_erasure(spark, str(path))
    assert len(read_erasure(spark, str(path), most=None)) == 12_000
    path.write_text("two words\n")
    with pytest.raises(ValueError):
        read_erasure(spark, str(path), most=None)

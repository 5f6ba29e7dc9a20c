import datetime as dt

from pyspark.sql import functions as F

from jobscope import functions as fn
from jobscope.functions.timing import parse_duration


def apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_names(spark):
    assert apply(spark, fn.class_to_type, ["EmailWorker", "Reports::DailyDigest", "HTTPServer", "simple", ""]) == [
        "email.worker",
        "reports.daily.digest",
        "httpserver",
        "simple",
        "",
    ]
    assert apply(spark, fn.name_to_type, ["EmailWorker", "sendEmail", "HTTPServer", "simple"]) == [
        "email.worker",
        "send.email",
        "h.t.t.p.server",
        "simple",
    ]
    assert apply(spark, fn.function_to_type, ["ValidateOrder", "extract_data", "-a--B_", "load-data"]) == [
        "validate.order",
        "extract.data",
        "a.b",
        "load.data",
    ]
    assert apply(spark, fn.pascal_case, ["email.send", "image-resize", "a b_c"]) == ["EmailSend", "ImageResize", "ABC"]
    assert apply(spark, fn.camel_case, ["email.send", "image-resize"]) == ["emailSend", "imageResize"]
    assert apply(spark, fn.snake_case, ["email.send", "image-resize"]) == ["email_send", "image_resize"]


def test_text(spark):
    assert apply(spark, fn.split_list, ["a,,b", " a, b", ""]) == [["a", "b"], [" a", " b"], []]
    assert apply(spark, fn.short_error, ["x" * 60, "x" * 61, None]) == ["x" * 60, "x" * 57 + "...", None]
    assert apply(spark, fn.wrap_in_array, ['{"a":1}', " [1]", "5"]) == ['[{"a":1}]', " [1]", "[5]"]
    assert apply(spark, lambda c: fn.percent_text(c.cast("double")), ["0.425", "1", None]) == ["42%", "100%", None]
    assert apply(spark, fn.arg_type, ["String", "integer", "number", "boolean", "object", "x"]) == ["string", "int", "float", "bool", "object", "any"]
    assert apply(spark, lambda c: fn.key_suffix(c, "queue:"), ["queue:a:b", "other"]) == ["a:b", None]


def test_times(spark):
    seconds = lambda c: F.unix_seconds(F.timestamp_seconds(F.lit(0)) + fn.duration(c))
    assert apply(spark, seconds, ["90s", "5m", "24h", "7d", "7w", ""]) == [90, 300, 86400, 604800, None, None]
    assert parse_duration("24h") == dt.timedelta(days=1)
    assert apply(spark, lambda c: fn.epoch_text(c.cast("double")), ["1.5", "2.5", "0", "-1"]) == ["2", "2", None, None]
    as_of = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    assert apply(spark, lambda c: fn.delay_to_timestamp(c.cast("bigint"), as_of), ["5000", "0"]) == ["2024-01-01T00:00:05Z", None]


def test_backoff(spark):
    df = spark.createDataFrame([("fixed", 3, 10), ("linear", 3, 10), ("exponential", 3, 10), ("polynomial", 3, 10)], "s string, a int, i int")
    got = df.select(fn.backoff_seconds(F.col("s"), F.col("a"), F.col("i"))).collect()
    assert [r[0] for r in got] == [10.0, 30.0, 40.0, 96.0]


def test_json_kinds(spark):
    doc = '{"a":"x","b":1,"c":1.5,"d":true,"e":{},"f":[1],"g":null}'
    df = spark.createDataFrame([(doc,)], "d string").select(F.try_parse_json("d").alias("v"))
    kinds = df.select(*[fn.json_kind(fn.member("v", f"$.{k}")).alias(k) for k in "abcdefgh"]).first()
    assert tuple(kinds) == ("string", "int", "number", "bool", "object", "array", "null", None)


def test_routing_is_stable_and_monotone(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    split = ids.select(*[fn.route("id", p).alias(f"p{p}") for p in (0, 30, 60, 100)])
    counts = split.agg(*[F.count_if(F.col(c) == "target").alias(c) for c in split.columns]).first()
    assert counts["p0"] == 0 and counts["p100"] == 2000
    assert 480 < counts["p30"] < 720
    assert split.filter("p30 = 'target' AND p60 = 'legacy'").count() == 0


def test_sql_functions(spark):
    fn.register_functions(spark)
    got = spark.sql("SELECT class_to_type('Mailers::WelcomeEmail'), split_list('a,,b'), epoch_text(2.5D), route_target('x', 100)").first()
    assert tuple(got) == ("mailers.welcome.email", ["a", "b"], "2", True)
    got = spark.sql(
        "SELECT state_class('dead'), arg_type('Integer'), key_suffix('queue:a', 'queue:'), audit_grade(45, 50), duration_seconds('5m'), duration_seconds('x'), "
        "backoff_seconds('linear', 3, 10), is_json_array('[1]'), is_json_array('{}'), celery_body('W10='), "
        "delay_to_timestamp(5000, TIMESTAMP_NTZ '2024-01-01 00:00:00'), dash_if_null(NULL), percent_text(0.425), short_error(repeat('x', 61))"
    ).first()
    assert tuple(got) == ("failed", "int", "a", "A", 300, None, 30.0, True, False, "[]", "2024-01-01T00:00:05Z", "-", "42%", "x" * 57 + "...")

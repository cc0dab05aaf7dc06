from pyspark.sql import functions as F

from cauce.functions.text import clean_generated, load_labels, parse_list_value
from cauce.operators import chat


def test_clean_generated(spark):
    cases = {
        "```text\nHola María\n```": "Hola María",
        "**Hola** amiga": "Hola amiga",
        "Mensaje: Hola": "Hola",
        "mensaje personalizado:   Hola": "Hola",
        "¡Claro! Aquí va": "Aquí va",
        '"Hola"': "Hola",
        "   ": None,
        '""': None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", clean_generated(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_parse_completions(spark):
    raws = {
        '{"choices":[{"message":{"content":" hola "},"finish_reason":"stop"}]}': (None, "hola"),
        "not json": ("invalid_json", None),
        "[1]": ("not_object", None),
        '{"choices": []}': ("no_choices", None),
        '{"choices": [1]}': ("bad_choice", None),
        '{"choices": [{"message": "x"}]}': ("bad_message", None),
        '{"choices": [{"message": {"content": ""}}]}': ("empty", None),
        '{"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]}': ("length", None),
        '{"choices": [{"message": {"content": "x"}, "finish_reason": "content_filter"}]}': ("content_filter", None),
    }
    df = spark.createDataFrame([(k,) for k in raws], "raw string")
    got = {r["raw"]: (r["error_code"], r["content"]) for r in chat.parse_completions(df, ["raw"]).collect()}
    assert got == raws


def test_intents_and_escalation(spark):
    turns = [(1, 0, "user", "Muchas gracias!"), (1, 1, "user", "Adiós, gracias"),
             (2, 0, "user", "zzz"), (2, 1, "user", "qqq"), (2, 2, "assistant", "ok"), (2, 3, "user", "www"),
             (2, 4, "user", "hablar con un agente")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    tags = {(r["conv_id"], r["turn"]): r["intent"] for r in chat.tag_intents(df.filter("role = 'user'")).collect()}
    assert tags[(1, 0)] == "thank_you" and tags[(1, 1)] == "ambiguous" and tags[(2, 4)] == "escalate"
    esc = {r["conv_id"]: (r["escalated"], r["escalation_turn"]) for r in chat.escalations(df).collect()}
    assert esc[2] == (True, 3) and esc[1] == (False, None)


def test_label_parsing(spark):
    df = spark.createDataFrame([('["a","b"]',), ("['x', 'y']",), ("",), (None,), ("solo",), ("[]",), ("{bad",)], "v string")
    got = [r["l"] for r in df.select(parse_list_value(F.col("v")).alias("l")).collect()]
    assert got == [["a", "b"], ["x", "y"], [], [], ["solo"], [], ["{bad"]]
    got2 = [r["l"] for r in df.select(load_labels(F.col("v")).alias("l")).collect()]
    assert got2[0] == ["a", "b"] and got2[2] == [] and got2[3] == [] and got2[6] == []

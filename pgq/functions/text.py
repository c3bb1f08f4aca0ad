"""Intents as text, prompts, training rows, and JSON found in a model's answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = {"=": "equal to", "!=": "different from", ">": "more than", "<": "less than", ">=": "at least", "<=": "at most", "contains": "containing"}
#: Operators in the sectioned text.
EXACT_WORDS = {">": "more than", ">=": "at least", "<": "less than", "<=": "at most", "=": "exactly equal to", "contains": "contains"}
RULES = "Turn the structured intent into exactly one question.  Keep its meaning: add nothing, leave nothing out, and give no explanation."
MARKER, STOP = "### Answer:", "<END>"


def wording(op: Column, words: dict[str, str] = WORDS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), op), op)


def value_text(f: Column, typed: bool = False) -> Column:
    """The value of a filter as text: the first of its typed fields, or its one value; <VALUE> without any."""
    given = [f["value_str"], f["value_int"].cast("string"), f["value_float"].cast("string")] if typed else [f["value"]]
    return F.coalesce(*given, F.lit("<VALUE>"))


def intent_text() -> Column:
    """One line for each part of a corpus row that is there."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Regime: "), F.col("regime")), F.concat(F.lit("Target: "), F.col("target")),
        F.when(F.size("path") > 0, F.concat(F.lit("Path: "), F.array_join(F.transform("path", lambda p: F.concat(p["src"], F.lit(" "), p["rel"], F.lit(" "), p["dst"])), ", "))),
        F.when(F.size("filters") > 0, F.concat(F.lit("Where: "), F.array_join(F.transform("filters", lambda f: F.concat(f["attribute"], F.lit(" "), wording(f["operator"]), F.lit(" "), F.coalesce(f["value"], F.lit("<VALUE>")))), " and "))),
        F.when(F.col("aggregate.function").isNotNull(), F.concat(F.lit("Compute: "), F.col("aggregate.function"), F.coalesce(F.concat(F.lit(" of "), F.col("aggregate.attribute")), F.lit("")))),
        F.when(F.col("order_by.attribute").isNotNull(), F.concat(F.lit("Order: "), F.col("order_by.attribute"), F.lit(" "), F.col("order_by.direction"))),
        F.when(F.col("limit").isNotNull(), F.concat(F.lit("Limit: "), F.col("limit").cast("string"))),
        F.when(F.size("return_attributes") > 0, F.concat(F.lit("Return: "), F.array_join("return_attributes", ", "))),
    )


def sections(typed: bool = False) -> Column:
    """A corpus row in sections, a heading and lines with a dash each, as question writers are shown it."""
    part = lambda title, lines: F.concat(F.lit(f"{title}:\n"), lines)
    dash = lambda c: F.concat(F.lit("- "), c)
    steps = F.array_join(F.transform("path", lambda p: F.concat(F.lit("- "), F.coalesce(p["dst"], F.lit("Unknown")), F.lit(" located inside "), F.coalesce(p["src"], F.lit("Unknown")))), "\n")

    def condition(f: Column) -> Column:
        node, attr, v = F.coalesce(f["node_label"], F.lit("None")), F.coalesce(f["attribute"], F.lit("None")), value_text(f, typed)
        return F.when((f["attribute"] == "type") & (f["operator"] == "="), F.concat(F.lit("- "), node, F.lit(" has type "), v)).otherwise(F.concat(F.lit("- "), node, F.lit(" "), attr, F.lit(" "), wording(f["operator"], EXACT_WORDS), F.lit(" "), v))

    g, o = F.col("aggregate"), F.col("order_by")
    return F.concat_ws(
        "\n\n", part("Query regime", dash(F.coalesce("regime", F.lit("unknown")))), part("Target entity", dash(F.col("target"))),
        F.when(F.size("path") > 0, part("Relationships", steps)), F.when(F.size("filters") > 0, part("Conditions", F.array_join(F.transform("filters", condition), "\n"))),
        F.when(g.isNotNull(), part("Aggregation", dash(F.concat(g["function"], F.coalesce(F.concat(F.lit(" of "), g["attribute"]), F.lit("")))))),
        F.when(o.isNotNull(), part("Sorting", dash(F.concat(o["attribute"], F.lit(" "), F.coalesce(o["direction"], F.lit("asc")))))),
        F.when(F.col("limit").isNotNull(), part("Limit", dash(F.col("limit").cast("string")))), F.when(F.size("return_attributes") > 0, part("Return", dash(F.array_join("return_attributes", ", ")))),
    )


# -- prompts ------------------------------------------------------------------------------------------------------------


def prompt(question: Column, system: str = "Answer with a query intent in JSON.", marker: str = MARKER) -> Column:
    return F.concat(F.lit(system + "\n### Question: "), F.trim(question), F.lit("\n" + marker + "\n"))


def instruction_prompt(question: Column, instruction: str) -> Column:
    """The prompt of training and of inference with either runtime: instruction, question, where the answer starts."""
    return F.concat(F.lit(f"### Instruction:\n{instruction}\n\n### Question:\n"), question, F.lit(f"\n\n{MARKER}\n"))


def question_prompt(rules: str = RULES, typed: bool = False) -> Column:
    """Asks for the question of a corpus row."""
    return F.concat(F.lit(f"[SYSTEM]\n{rules}\n\n[USER]\n"), sections(typed))


def paraphrase_prompt(question: Column, regime: Column, instructions: dict[str, str], n: int) -> Column:
    """Asks for n more wordings of a question; regimes without instructions give null."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in instructions.items() for x in kv]), regime)
    return F.concat(F.lit("Query regime: "), regime, F.lit("\n\n"), own, F.lit(f"\n\nGenerate {n} paraphrases.\n\nQuestion:\n\""), question, F.lit('"'))


# -- training rows ------------------------------------------------------------------------------------------------------


def typed_value(value: Column, kind: Column) -> Column:
    """A value as text in the field of its attribute's kind: numbers in value_int or value_float, all else in value_str."""
    number = kind.isin("int", "float", "number")
    whole, real = value.try_cast("bigint"), value.try_cast("double")
    plain = value.rlike(r"^-?[0-9]+$")
    as_int, as_real = number & plain & whole.isNotNull(), number & ~plain & real.isNotNull()
    return F.struct(
        F.when(~F.coalesce(as_int | as_real, F.lit(False)), value).alias("value_str"), F.when(as_int, whole).alias("value_int"), F.when(as_real, real).alias("value_float"),
    )


def schema_json(kinds: dict[str, dict[str, str]]) -> Column:
    """The schema of a corpus row as JSON, with filter values in typed fields; kinds: label -> attribute -> kind."""
    table = F.create_map(*[F.lit(x) for l, a in kinds.items() for k, t in a.items() for x in (f"{l}.{k}", t)])

    def one(f: Column) -> Column:
        v = typed_value(f["value"], F.coalesce(F.try_element_at(table, F.concat_ws(".", F.coalesce(f["node_label"], F.col("target")), f["attribute"])), F.lit("str")))
        return F.struct(f["node_label"].alias("node_label"), f["attribute"].alias("attribute"), f["operator"].alias("operator"), *[v[k].alias(k) for k in ("value_str", "value_int", "value_float")])

    label = lambda c: F.struct(c.alias("label"))
    path = F.transform("path", lambda p: F.struct(label(p["src"]).alias("source"), p["rel"].alias("relationship"), label(p["dst"]).alias("target")))
    return F.to_json(F.struct(label(F.col("target")).alias("target"), path.alias("path"), F.transform("filters", one).alias("filters"), "order_by", "limit", "aggregate", "return_attributes"), {"ignoreNullFields": "false"})


def training_rows(rows: DataFrame, question: str, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """question, regime, schema (JSON) of the corpus rows that have a question."""
    return rows.where(F.col(question).isNotNull()).select(F.trim(F.col(question)).alias("question"), "regime", schema_json(kinds).alias("schema"))


def _pretty(regime: pd.Series, schema: pd.Series) -> pd.Series:
    """Keys in order, indent 2: Spark's own pretty printer sets colons and lists in another way."""
    one = lambda r, s: json.dumps({"regime": r, "schema": json.loads(s) if s else None}, ensure_ascii=False, indent=2, sort_keys=True)
    return pd.Series([one(r, s) for r, s in zip(regime, schema, strict=True)])


def target_json(regime: Column, schema: Column, stop: str = STOP) -> Column:
    """What a model is trained to answer: regime and schema as JSON, a line break and the stop token."""
    return F.concat(F.pandas_udf(_pretty, "string")(regime, schema), F.lit("\n" + stop))


# -- answers ------------------------------------------------------------------------------------------------------------


def answer(text: Column, marker: str = MARKER, stop: str = STOP) -> Column:
    """What follows the last marker, up to the stop token."""
    return F.trim(F.split_part(F.element_at(F.split(text, marker), -1), F.lit(stop), F.lit(1)))


def first_object(text: Column) -> Column:
    """The first balanced {...}, braces inside strings counted as well: a walk over the pieces that end in a brace."""
    pieces = F.regexp_extract_all(text, F.lit(r"([^{}]*[{}])"), 1)
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        at, opens, done = s["at"] + F.length(piece), F.endswith(piece, F.lit("{")), s["end"] > 0
        depth = F.when(done, s["depth"]).when(opens, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        start = F.when(~done & opens & (s["depth"] == 0), at).otherwise(s["start"])
        end = F.when(~done & ~opens & (s["depth"] == 1), at).otherwise(s["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), start.alias("start"), end.alias("end"))

    found = F.aggregate(pieces, state, step)
    return F.when(found["end"] > 0, F.substring(text, found["start"], found["end"] - found["start"] + 1))


def string_array(s: Column) -> Column:
    """A JSON list of strings, or what lies between the first [ and the last ]."""
    inner = F.regexp_extract(s, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(s, "array<string>"), F.from_json(F.when(inner != "", inner), "array<string>"))


def predict(questions: DataFrame, predictor: Callable[[Sequence[str]], Sequence[str]], column: str = "question") -> DataFrame:
    """Add `prediction`, by a predictor that takes the questions of a whole batch and is loaded once a task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema) + ", prediction string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(prediction=list(predictor(b[column].tolist())))

    return questions.mapInPandas(run, schema)


def process(rows: DataFrame, writer: Callable[[Sequence[str]], Sequence[str | None]], typed: bool = False, rules: str = RULES) -> DataFrame:
    """Questions for corpus rows, by a writer that takes the prompts of a batch: the generation step.  Adds `question`, null
    where the writer gave none."""
    asked = rows.withColumn("_prompt", question_prompt(rules, typed))
    return predict(asked, writer, "_prompt").withColumnRenamed("prediction", "question").drop("_prompt")


def paraphrased(rows: DataFrame, writer: Callable[[Sequence[str]], Sequence[str | None]], instructions: dict[str, str], n: int = 15) -> DataFrame:
    """rows (question, regime, ..) and, for each, one more row for each text in the JSON list that the writer answers.
    Answers that hold no list add none."""
    asked = rows.withColumn("_prompt", paraphrase_prompt(F.col("question"), F.col("regime"), instructions, n))
    more = predict(asked.where("_prompt is not null"), writer, "_prompt").withColumn("question", F.explode(string_array(F.trim("prediction"))))
    return rows.unionByName(more.select(rows.columns))


def paraphrases(questions: DataFrame, templates: tuple[str, ...] = ("Please tell me: {}", "I would like to know: {}")) -> DataFrame:
    """Originals and one more row for each template, a stand-in for a model behind the same shape."""
    more = F.array(F.col("question"), *[F.format_string(t.replace("{}", "%s"), F.col("question")) for t in templates])
    return questions.withColumn("question", F.explode(more))

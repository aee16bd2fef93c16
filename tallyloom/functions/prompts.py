"""Texts that items are asked by, and names that follow from what an item is."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bind import let
from .parsing import final_answer, folded, parse_number, parse_words, parse_yes_no
from .rules import answer_digits, carry_label, hash_text

#: What a training text may hold.
SURFACE = "^[0-9+=]*$"


def hash_mod(digest: Column, modulus: int) -> Column:
    """A hexadecimal digest as a number, modulo any number below 2 ** 59: digit by digit."""
    digit = lambda c: (F.instr(F.lit("0123456789abcdef"), c) - 1).cast("long")
    return F.aggregate(F.split(digest, ""), F.lit(0).cast("long"), lambda s, c: (s * 16 + digit(c)) % modulus)


def third_operand(a: Column, b: Column, seed: int, choices: Sequence[int], tag: str) -> Column:
    """The operand that a pair is asked with: chosen by the first 16 digits of the hash of tag, seed and pair, whatever else is chosen."""
    digest = F.substring(hash_text(tag, seed, a, b), 1, 16)
    return F.get(F.lit([int(c) for c in choices]), hash_mod(digest, len(choices)).cast("int"))


def order_index(item_id: Column, n_lines: int, tag: str) -> Column:
    """Which of the n! orders of the preamble's lines an item has, in lexicographic order, by the hash of its id."""
    n = 1
    for k in range(2, n_lines + 1):
        n *= k
    return hash_mod(hash_text(tag, F.concat(F.lit('"'), item_id, F.lit('"'))), n)


def with_preamble(prompt: Column, lines: Sequence[str], item_id: Column, tag: str, end: str = "\n") -> Column:
    """The prompt after the lines in the item's order; without lines the prompt as it is. At most six lines."""
    if not lines:
        return prompt
    if len(lines) > 6:
        raise ValueError("more than six lines have too many orders to list")
    texts = ["\n".join(order) for order in permutations(lines)]
    return F.concat(F.get(F.lit(texts), order_index(item_id, len(lines), tag).cast("int")), F.lit(end), prompt)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with {name} replaced by values; what is left in braces is an error."""
    text = template
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return F.when(text.rlike(r"\{[a-z_]+\}"), F.raise_error(F.lit("a placeholder has no value")).cast("string")).otherwise(text)


def render_prompts(items: DataFrame, templates: dict[str, str], values: dict[str, Column], category: str = "category") -> DataFrame:
    """Adds `prompt` by the template of each item's category; a category without a template is an error. Templates are few and go as literals."""
    table = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair))
    found = F.try_element_at(table, F.col(category))
    template = F.coalesce(found, F.raise_error(F.concat(F.lit("no template for "), F.coalesce(F.col(category), F.lit("null")))).cast("string"))
    return items.withColumn("prompt", filled(template, values))


def item_id(pool: Column, group: Column, category: Column, operands: Column, params: Column) -> Column:
    """The name that an item's content gives it: pool, group, category, operands, and parameters by name if there are any. Fewer than two operands are an error."""
    numbers = F.array_join(F.transform(operands, lambda x: x.cast("string")), "_")
    detail = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e.key, e.value)), "-")
    name = F.concat_ws(".", pool, group, category, numbers, F.when(F.coalesce(F.length(detail), F.lit(0)) > 0, detail))
    return F.when(F.size(operands) < 2, F.raise_error(F.lit("an item needs two operands")).cast("string")).otherwise(name)


def make_items(df: DataFrame, pool: str) -> DataFrame:
    """item_id, pool_id, group, category, operands, carry of the first two, and params of rows of group, category, operands, params."""
    name = item_id(F.lit(pool), F.col("group"), F.col("category"), F.col("operands"), F.col("params"))
    carry = carry_label(F.get("operands", 0), F.get("operands", 1))
    return df.select(name.alias("item_id"), F.lit(pool).alias("pool_id"), "group", "category", "operands", carry.alias("carry"), "params")


def surface(text: Column) -> Column:
    """A training text; anything but digits, + and = is an error."""
    return F.when(text.rlike(SURFACE), text).otherwise(F.raise_error(F.concat(F.lit("not a training text: "), text)).cast("string"))


def render_examples(pairs: DataFrame, condition: str, target: Column, prompt: str, completion: str) -> DataFrame:
    """Training rows of pairs (a, b, repeat_index): the only place where a rule reaches a text. A target below zero is an error."""
    a, b, total = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    checked = F.when(target < 0, F.raise_error(F.lit("a target is below zero")).cast("bigint")).otherwise(target.cast("bigint"))
    rows = pairs.withColumn("target", checked)
    return rows.select(
        F.format_string(f"{condition}.%04d-%04d.r%d", a.cast("long"), b.cast("long"), F.col("repeat_index").cast("long")).alias("example_id"),
        "a", "b", total.alias("true_sum"), "target",
        surface(filled(F.lit(prompt), {"a": a, "b": b})).alias("prompt"),
        surface(filled(F.lit(completion), {"target": F.col("target")})).alias("completion"),
        carry_label(a, b).alias("carry"), answer_digits(total).alias("answer_digits"), "repeat_index",
    )


def with_phrase_replaced(prompt: Column, phrase: Column, by: Column) -> Column:
    """The prompt with a phrase replaced that occurs once; more or less often is an error."""
    times = (F.length(prompt) - F.length(F.replace(prompt, phrase, F.lit("")))) / F.length(phrase)
    return F.when(times == 1, F.replace(prompt, phrase, by)).otherwise(F.raise_error(F.lit("the phrase must occur once")).cast("string"))


def parse_response(text: Column, binary: Column, elicitation: Column) -> Column:
    """struct(number, answer): the number of a numeric answer or the yes or no of a binary one. `steps` reads the final line, `words` number words, `direct` the text.

    Compatibility forms are folded in the whole text, before a final line is looked for. text has to be a plain column: the folding is not JVM-side, and Spark cannot plan it over expressions with lambdas.
    """

    def read(line: Column) -> Column:
        number = F.when(elicitation == "words", parse_words(line, fold=False)).otherwise(parse_number(line, fold=False))
        return F.struct(F.when(~binary, number).alias("number"), F.when(binary, parse_yes_no(line, fold=False)).alias("answer"))

    return let(folded(text), lambda t: let(F.when(elicitation == "steps", final_answer(t)).otherwise(t), read))


def candidates(difference: Column, a: Column, b: Column, offset: int) -> Column:
    """array of struct(name, value): what an answer to a - b (where `difference` holds) or a * b may be, the first in order of precedence first."""
    t = F.when(difference, a - b).otherwise(a * b)
    named = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("long").alias("value"))
    both = [named("truth", t), named(f"t+{offset}", t + offset), named(f"t-{offset}", t - offset)]
    only = [named(f"-t+{offset}", offset - t), named("-t", -t), named(f"a+b+{offset}", a + b + offset)]
    return F.when(difference, F.array(*both, *only)).otherwise(F.array(*both))


def matching(cands: Column, value: Column) -> Column:
    """Names of the candidates that a value equals, in order."""
    return F.transform(F.filter(cands, lambda c: c.value == value), lambda c: c["name"])

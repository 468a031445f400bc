"""Column functions on names: file names, activity names, text preparation."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def type_name(path: Column) -> Column:
    """File name without extension and digits."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), r"\d+", "")


def clean_file_name(path: Column) -> Column:
    """Lower-cased type name without blanks, used to group files by name."""
    return F.lower(F.regexp_replace(type_name(path), r"\s+", ""))


def normalize_activity(name: Column) -> Column:
    """Lower-cased and without blanks."""
    return F.replace(F.lower(name), F.lit(" "), F.lit(""))


# An activity name is `(('in', ...), ('out', ...))`, and this is the name of no type.
_QUOTED = r"'([^']*)'"
_BETWEEN = r"\)\s*,\s*\("
_NO_TYPE = "None"


def _quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(1))


def _side(name: Column, n: int) -> Column:
    """Names of one of the two lists, without blanks; null for texts that are no activity name."""
    lists = F.split(F.trim(name), _BETWEEN)
    names = F.transform(_quoted(F.get(lists, F.lit(n))), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    return F.when((F.size(lists) == 2) & F.startswith(F.trim(name), F.lit("((")), F.array_sort(F.array_distinct(names)))


def activity_inputs(name: Column) -> Column:
    return _side(name, 0)


def activity_outputs(name: Column) -> Column:
    return _side(name, 1)


def target_type(name: Column) -> Column:
    """The last type an activity name quotes, empty if it quotes none but the empty one; a text without
    quotes is a type itself."""
    types = F.filter(_quoted(name), lambda x: ~x.isin("", _NO_TYPE))
    last = F.coalesce(F.try_element_at(types, F.lit(-1)), F.lit(""))
    return F.when(name.contains("'"), last).otherwise(F.trim(name))


def activity_name(inputs: Column, outputs: Column) -> Column:
    """`(('a', 'b'), ('c'))` from two arrays of type names."""
    def quoted(names: Column) -> Column:
        return F.concat(F.lit("('"), F.array_join(names, "', '"), F.lit("')"))

    return F.concat(F.lit("("), quoted(inputs), F.lit(", "), quoted(outputs), F.lit(")"))


def prepared_tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-cased alphanumeric tokens without stop words; the first quoted token is put in front."""
    quoted = F.regexp_extract(text, r'"([^"]+)"', 1)
    whole = F.lower(F.when(quoted != "", F.concat(quoted, F.lit(" "), text)).otherwise(text))
    tokens = F.split(whole, r"[^\p{L}\p{N}]+")
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(*stop_words))

"""Column functions: built-in Spark expressions, no Python in tasks."""

from prefspark.functions.text import (  # noqa: F401
    clean_text, cut_at_stop, preview, py_strip, render_fewshot_prompt, turn_agg,
    render_generation_prompt, render_judge_prompt, render_training_text,
    short_subject, turn_text,
)
from prefspark.functions.extract import (  # noqa: F401
    extract_gold, extract_number, parse_verdict,
)
from prefspark.functions.vectors import dot, sq_norm  # noqa: F401

"""Values that must equal the behaviour being reproduced.

Everything in the "Fixed values" blocks is data, not logic: chat-template
markers, prompt texts, the subject list and the numeric defaults.
"""

# ---------------------------------------------------------------------------
# Chat template markers (Llama-3 style header/turn tokens).
# ---------------------------------------------------------------------------
BEGIN_OF_TEXT = "<|begin_of_text|>"
USER_HEADER = "<|start_header_id|>user<|end_header_id|>\n\n"
ASSISTANT_HEADER = "<|start_header_id|>assistant<|end_header_id|>\n\n"
END_OF_TURN = "<|eot_id|>"
EMPTY_TURN = "empty"

# ---------------------------------------------------------------------------
# Two-example math prompt; the question follows "Q: ".
# ---------------------------------------------------------------------------
FEWSHOT_PREFIX = (
    "Q: There are 15 trees in the grove. Grove workers will plant trees in the grove today. "
    "After they are done, there will be 21 trees. How many trees did the grove workers plant today?\n"
    "A: There are 15 trees originally. Then there were 21 trees after some more were planted. "
    "So there must have been 21 - 15 = 6. The answer is 6.\n"
    "\n"
    "Q: Leah had 32 chocolates and her sister had 42. If they ate 35, how many pieces do they "
    "have left in total?\n"
    "A: Originally, Leah had 32 chocolates. Her sister had 42. So in total they had 32 + 42 = 74. "
    "After eating 35, they had 74 - 35 = 39. The answer is 39.\n"
    "\n"
    "Q: "
)
FEWSHOT_SUFFIX = "\nA:"
STOP_MARKER = "Q:"
ANSWER_MARKER = "The answer is"
# Python-semantics number pattern; prefixed with (?U) on the JVM side.
NUMBER_PATTERN = r"[-+]?\d*\.\d+|\d+"
GOLD_PATTERN = r"####\s*([-+]?\d*\.\d+|\d+)"
VERDICT_PATTERN = r"\b([12])\b"

# ---------------------------------------------------------------------------
# Pairwise judge prompt, as literal segments around the three
# slots (instruction, output_1, output_2).
# ---------------------------------------------------------------------------
JUDGE_HEAD = (
    "I want you to evaluate which of the following two AI assistant responses is better "
    "for the given user instruction.\n"
    "\n"
    "<user_instruction>\n"
)
JUDGE_MID_1 = "\n</user_instruction>\n\n<response_1>\n"
JUDGE_MID_2 = "\n</response_1>\n\n<response_2>\n"
JUDGE_TAIL = (
    "\n</response_2>\n"
    "\n"
    "Please evaluate both responses and determine which one better follows the instruction, "
    "is more helpful, accurate, and of higher quality overall.\n"
    "\n"
    'Respond with ONLY "1" if Response 1 is better, or "2" if Response 2 is better. '
    "Do not include any explanation."
)

# ---------------------------------------------------------------------------
# Numeric defaults.
# ---------------------------------------------------------------------------
DAMPING_DIVISOR = 1000  # lambda = mean squared gradient norm / 1000
TOP_K = 3
PREVIEW_CHARS = 80
JUDGE_MAX_ATTEMPTS = 5
SELF_PAIR_SEED = 42
SUBJECT_PREFIX = "mmlu_"
LENGTH_FEATURES = ["length_diff", "length_diff_sq", "log_model_len", "log_ref_len"]

# ---------------------------------------------------------------------------
# The 57 canonical subjects, in canonical order.
# ---------------------------------------------------------------------------
MMLU_SUBJECTS = [
    "mmlu_abstract_algebra", "mmlu_anatomy", "mmlu_astronomy",
    "mmlu_business_ethics", "mmlu_clinical_knowledge", "mmlu_college_biology",
    "mmlu_college_chemistry", "mmlu_college_computer_science",
    "mmlu_college_mathematics", "mmlu_college_medicine", "mmlu_college_physics",
    "mmlu_computer_security", "mmlu_conceptual_physics", "mmlu_econometrics",
    "mmlu_electrical_engineering", "mmlu_elementary_mathematics",
    "mmlu_formal_logic", "mmlu_global_facts", "mmlu_high_school_biology",
    "mmlu_high_school_chemistry", "mmlu_high_school_computer_science",
    "mmlu_high_school_european_history", "mmlu_high_school_geography",
    "mmlu_high_school_government_and_politics", "mmlu_high_school_macroeconomics",
    "mmlu_high_school_mathematics", "mmlu_high_school_microeconomics",
    "mmlu_high_school_physics", "mmlu_high_school_psychology",
    "mmlu_high_school_statistics", "mmlu_high_school_us_history",
    "mmlu_high_school_world_history", "mmlu_human_aging", "mmlu_human_sexuality",
    "mmlu_international_law", "mmlu_jurisprudence", "mmlu_logical_fallacies",
    "mmlu_machine_learning", "mmlu_management", "mmlu_marketing",
    "mmlu_medical_genetics", "mmlu_miscellaneous", "mmlu_moral_disputes",
    "mmlu_moral_scenarios", "mmlu_nutrition", "mmlu_philosophy",
    "mmlu_prehistory", "mmlu_professional_accounting", "mmlu_professional_law",
    "mmlu_professional_medicine", "mmlu_professional_psychology",
    "mmlu_public_relations", "mmlu_security_studies", "mmlu_sociology",
    "mmlu_us_foreign_policy", "mmlu_virology", "mmlu_world_religions",
]

# ---------------------------------------------------------------------------
# The characters Python's str.strip() removes (str.isspace()).
# Spark's trim() only removes spaces, so a regex class is used instead.
# ---------------------------------------------------------------------------
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
                 "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

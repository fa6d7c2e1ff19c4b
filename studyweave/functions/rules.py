"""Keyword ladders, patterns, thresholds and weights that results depend on.

A ladder is a list of (outcome, phrases) in order of precedence; a phrase counts wherever it occurs in the
lower-cased text, also inside a word.
"""

from __future__ import annotations

# Pedagogy roles by text, then by section title.
ROLE_LADDER = [
    ("definition", ["is defined as", "we define", "definition:", "let us define"]),
    ("proof", ["proof:", "to prove", "q.e.d.", "∴", "we prove that", "it follows that"]),
    ("example", ["for example", "for instance", "consider the case", "as an example"]),
    ("derivation", ["deriving", "starting from", "we obtain", "derivation of", "to derive"]),
    ("application", ["in practice", "real-world", "application", "used in", "practical use"]),
    ("problem", ["problem:", "exercise:", "find the", "calculate", "solve for"]),
    ("summary", ["summary", "in conclusion", "key points", "to summarize", "recap"]),
]
ROLE_TITLE_LADDER = [
    ("example", ["example"]),
    ("proof", ["proof"]),
    ("application", ["application"]),
    ("problem", ["problem", "exercise"]),
    ("definition", ["definition"]),
]
ROLE_DEFAULT = "explanation"

# Content types; the last one looks at the first 200 characters only.
CONTENT_LADDER = [
    ("definition", ["definition:", "is defined as", "we define"]),
    ("theorem", ["theorem:", "lemma:", "corollary:"]),
    ("proof", ["proof:", "to prove", "we can show"]),
    ("example", ["example", "for instance", "consider the case"]),
    ("problem", ["problem:", "exercise:", "find", "calculate"]),
    ("solution", ["solution:", "solving", "we obtain"]),
    ("derivation", ["derivation", "deriving", "starting from"]),
    ("summary", ["summary", "in conclusion", "to summarize"]),
]
CONTENT_INTRO = ["introduction", "overview", "concept of"]
CONTENT_INTRO_CHARS = 200

# Formula types by case-sensitive markup.
FORMULA_LADDER = [
    ("differential_equation", ["\\frac{d", "\\partial"]),
    ("integral", ["\\int"]),
    ("summation", ["\\sum"]),
    ("limit", ["\\lim"]),
    ("matrix", ["\\begin{matrix", "\\begin{bmatrix"]),
    ("inequality", ["<", ">", "\\leq", "\\geq", "\\neq"]),
]

# Difficulty points.
FORMULA_POINTS = {"differential_equation": 10, "integral": 8, "matrix": 6, "summation": 6}
ABSTRACT_CONCEPTS = ["theory", "principle", "theorem", "axiom", "postulate"]
MATH_POINTS = [
    (25, ["differential", "partial derivative", "laplacian"]),
    (20, ["integral", "derivative", "calculus"]),
    (15, ["trigonometric", "logarithm", "exponential"]),
    (10, ["algebra", "equation", "formula"]),
]

# Levels of thinking, the highest found counts (2 if none).
BLOOM = {
    1: ["define", "list", "name", "identify", "recall", "state"],
    2: ["explain", "describe", "summarize", "interpret", "discuss"],
    3: ["apply", "calculate", "solve", "use", "demonstrate", "compute"],
    4: ["analyze", "compare", "contrast", "examine", "differentiate"],
    5: ["evaluate", "justify", "critique", "assess", "judge"],
    6: ["create", "design", "develop", "formulate", "construct"],
}
# Mathematical levels, the last found counts.
MATH_LEVELS = [
    ("arithmetic", ["addition", "subtraction", "multiplication", "division", "percentage"]),
    ("algebra", ["equation", "variable", "solve", "linear", "quadratic"]),
    ("trigonometry", ["sine", "cosine", "tangent", "angle", "triangle"]),
    ("calculus", ["derivative", "integral", "differential", "limit", "gradient"]),
    ("advanced", ["partial differential", "tensor", "vector calculus", "laplacian", "fourier"]),
]
ABSTRACT_WORDS = ["theory", "principle", "axiom", "theorem", "postulate", "law"]

# The two sides of a comparison in a caption, and kinds of figures by caption.
VERSUS = r"(\w+(?:\s+\w+)?)\s+versus\s+(\w+(?:\s+\w+)?)"
FIGURE_KINDS = [
    ("graph", ["plot", "curve", "versus", "vs", "axis", "axes"]),
    ("diagram", ["schematic", "diagram", "illustration", "flowchart"]),
    ("photograph", ["photo", "photograph", "image", "picture"]),
    ("schematic", ["circuit", "schematic", "wiring", "layout"]),
    ("chart", ["chart", "bar", "pie", "histogram"]),
]

# LaTeX delimiters, longest environments first (DOTALL except for \( \)).
LATEX_PATTERNS = [
    r"(?s)\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}",
    r"(?s)\\begin\{align\*?\}(.*?)\\end\{align\*?\}",
    r"(?s)\\begin\{eqnarray\*?\}(.*?)\\end\{eqnarray\*?\}",
    r"(?s)\\begin\{gather\*?\}(.*?)\\end\{gather\*?\}",
    r"(?s)\\\[(.*?)\\\]",
    r"(?s)\$\$(.*?)\$\$",
    r"\\\((.*?)\\\)",
    r"\$([^$]+)\$",
]
# Formula positions.
FORMULA_PATTERNS = [
    r"(?s)\\begin\{equation\}.*?\\end\{equation\}",
    r"(?s)\\begin\{align\}.*?\\end\{align\}",
    r"(?s)\\begin\{eqnarray\}.*?\\end\{eqnarray\}",
    r"(?s)\$\$.*?\$\$",
    r"\$[^$]+\$",
    r"[a-zA-Z]\s*=\s*[^,\n]{3,}",
    r"\w+\([^)]+\)\s*=\s*[^,\n]+",
]
LATEX_FUNCTIONS = ["frac", "sqrt", "sin", "cos", "tan", "log", "ln", "exp", "int", "sum", "prod", "lim", "partial", "nabla", "cdot", "times", "div", "grad", "curl"]
GREEK = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega"]

# Token limits (least, most) per content type.
SIZE_LIMITS = {"concept_intro": (100, 300), "derivation": (300, 500), "example": (150, 400), "summary": (50, 150)}
SIZE_DEFAULT = (100, 300)

# References, as (kind, written form, patterns with one group).
NUMBER = r"([0-9]+\.?[0-9]*)"
REFERENCES = [
    ("equations", "Eq. ", [r"(?i)\b(?:Eq|Equation)\.?\s*" + NUMBER, r"\(" + NUMBER + r"\)", r"\[" + NUMBER + r"\]"]),
    ("figures", "Fig. ", [r"(?i)\b(?:Fig|Figure)\.?\s*" + NUMBER]),
    ("tables", "Table ", [r"(?i)\b(?:Tab|Table)\.?\s*" + NUMBER]),
    ("sections", "Section ", [r"(?i)\b(?:Sec|Section)\.?\s*" + NUMBER]),
    ("chapters", "Chapter ", [r"(?i)\bChapter\s+([0-9]+)"]),
]

# What is no concept.
NOISE_PATTERNS = [
    r"^[0-9.\s]+$", r"^page\s+[0-9]+", r"^chapter\s+[0-9]+", r"^[0-9]+°[cf]$", r"^\(cid:[0-9]+\)", r"^figure\s+[0-9]+", r"^table\s+[0-9]+",
    r"^eq\.\s*[0-9]+", r"^section\s+[0-9]+", r"^example\s+[0-9]+", r"^[0-9]{4}$", r"^[a-z]$", r"^(i{1,3}|iv|v|vi{1,3}|ix|x)$",
]
GENERIC_TERMS = ["mathematics", "physics", "chemistry", "biology", "science", "engineering", "theory", "concept", "method", "approach", "technique", "process", "system", "model", "analysis", "study"]

# Concept names.
ACRONYMS = {
    "DFT": "Discrete Fourier Transform",
    "FFT": "Fast Fourier Transform",
    "PDE": "Partial Differential Equation",
    "ODE": "Ordinary Differential Equation",
    "BVP": "Boundary Value Problem",
    "IVP": "Initial Value Problem",
}
SYNONYMS = [
    ["Heat Transfer", "heat transfer", "Heat Xfer", "thermal transfer"],
    ["Fourier Law", "Fourier's Law", "Fourier's law of heat conduction"],
    ["Conduction", "Heat Conduction", "thermal conduction"],
]
FUZZY = 0.85
ALIAS = 0.78

# Least confidence per kind of relation.
RELATION_CONFIDENCE = {"DEFINES": 0.80, "PREREQUISITE_OF": 0.75, "DERIVES": 0.75, "EXPLAINS": 0.65, "APPLIES_TO": 0.65, "EXEMPLIFIES": 0.60, "RELATED_TO": 0.65}
COMPLEX_TERMS = ["law", "theorem", "equation", "theory", "coefficient", "parameter", "variable", "differential", "integral", "partial"]
COMPLEX_SIGNS = ["∂", "∫", "∑", "α", "β", "γ"]

# Mastery levels [low, high).
LEVELS = [("beginner", 0.0, 0.3), ("developing", 0.3, 0.6), ("proficient", 0.6, 0.8), ("mastering", 0.8, 1.01)]

# Reward weights, thresholds and phrases.
REWARD_WEIGHTS = {"stepwise_rubric": 0.0, "rubric": 0.4, "intent": 0.2, "gating": 0.2, "grounding": 0.15, "style": 0.05}
REWARD_THRESHOLDS = {"stepwise_rubric": 0.6, "rubric": 0.6, "intent": 0.6, "gating": 0.7, "grounding": 0.65, "style": 0.5}
BANNED = ["as an ai language model", "i am an ai"]
SUGGESTIONS = ["try", "consider", "can you", "let's", "what about"]
EXAMPLES = ["for example", "for instance", "such as", "e.g."]
REASONS = ["because", "therefore", "so that", "as a result"]
ANSWERS = ["is", "are", "means", "refers", "defines"]
MIN_WORDS, MAX_WORDS, LONG_SENTENCE, ADVANCED_PENALTY = 30, 220, 32, 0.4
INTENT_ACTIONS = {
    "question": ["explain", "hint", "worked_example"],
    "answer": ["reflect", "ask", "review"],
    "reflection": ["reflect", "ask", "review"],
    "off_topic": ["review", "ask", "explain"],
    "greeting": ["ask", "explain"],
    "unknown": ["explain", "ask", "review"],
}
STEP_WEIGHTS = {"understand_student": 0.15, "select_pedagogy": 0.25, "retrieve_content": 0.20, "structure_response": 0.20, "generate_output": 0.15, "formative_check": 0.05}
FLOW = [["first", "initially", "to start"], ["then", "next", "after"], ["finally", "in conclusion", "overall"]]
REFLECTION = ["what do you think", "can you explain", "how would you", "try"]
NEXT_STEPS = ["next", "then", "after this", "once you understand"]

# Chunk types that a tagger may give (else summary), concepts kept, prices per token and per GB and month.
CHUNK_TYPES = ["definition", "theorem", "example", "exercise", "formula", "summary", "derivation", "procedure", "fact"]
MOST_CONCEPTS = 5
TOKEN_PRICES = {"gpt-3.5-turbo": 0.002 / 1000, "gpt-4": 0.03 / 1000, "gpt-4-turbo": 0.01 / 1000}
STORAGE_PRICE = 0.023

# Mastery from which a concept is no focus any more, as asked for and on the path.
PRIMARY_MASTERED, PATH_MASTERED = 0.85, 0.8
# Words that count as agreement in a message.
AGREEMENT = ["correct", "right", "agreed"]
# Texts of responses without a model, and the confidence of a quoted snippet.
EXAMPLE_STEPS = [
    "1. Identify the known quantities or facts from the prompt.",
    "2. Apply the relevant principle for the concept.",
    "3. Compute or reason through the result step by step.",
    "4. Double-check the conclusion and relate it back to the concept.",
]
REVIEW_HINT = "Note the key relationships and examples discussed."
NO_CHUNKS = "I couldn't find a grounded snippet yet. Let's review your materials first. Could you point me to the chapter or section?"
NO_SNIPPET = "I couldn't find a grounded snippet yet. Let's review the relevant materials together. Do you recall which section covers this concept?"
SNIPPET_BEFORE, SNIPPET_AFTER = "Here's what your materials say about this topic:\n\n", "\n\nLet me know if you'd like a different angle."
SNIPPET_CONFIDENCE = 0.5
# Keys that a request to an agent must have.
AGENT_KEYS = {"study-plan": [], "daily-quiz": ["concepts"], "doubt": ["question"], "analysis": ["user_id"], "tutor": ["message", "user_id"], "mock": []}
# A variable: a name with an optional subscript and power.
VARIABLE = r"\\?([a-zA-Z]+)(?:_\{?([a-zA-Z0-9]+)\}?)?(?:\^(\{[^}]+\}|[^\\\s,})]+))?"
# Signs without which a pattern finds nothing; those of references in lower case.
SIGNS = {
    **dict(zip(LATEX_PATTERNS, (["\\begin{equation"], ["\\begin{align"], ["\\begin{eqnarray"], ["\\begin{gather"], ["\\["], ["$$"], ["\\("], ["$"]))),
    **dict(zip(FORMULA_PATTERNS, (["\\begin{equation}"], ["\\begin{align}"], ["\\begin{eqnarray}"], ["$$"], ["$"], ["="], ["(", "="]))),
    **dict(zip((p for _, _, ps in REFERENCES for p in ps), (["eq"], ["("], ["["], ["fig"], ["tab"], ["sec"], ["chapter"]))),
}

"""Semantic categories of items: by benchmark where one decides, else by patterns in the content, the first that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories in their order, the benchmarks that decide alone, and the patterns.
CATEGORIES = [
    "open_ended_chat_creative_instruction",
    "multilingual_translation",
    "nli_commonsense_reasoning",
    "mcq_stem_text",
    "mcq_humanities_social_science",
    "clinical_medical_qa",
    "competition_olympiad_math",
    "visual_math_reasoning",
    "visual_qa_diagram_understanding",
    "frontier_last_exam_reasoning",
    "algorithmic_competitive_programming",
    "real_world_software_engineering",
    "tool_use_function_calling",
    "agentic_gui_os_tasks",
    "safety_refusal_adversarial_robustness",
]
DIRECT = {
    "afrimedqa": "clinical_medical_qa",
    "mathvista_mini": "visual_math_reasoning",
    "ai2d_test": "visual_qa_diagram_understanding",
    "mmbench_v11": "visual_qa_diagram_understanding",
    "livecodebench": "algorithmic_competitive_programming",
    "swebench": "real_world_software_engineering",
    "bfcl": "tool_use_function_calling",
    "androidworld": "agentic_gui_os_tasks",
    "cybench": "agentic_gui_os_tasks",
    "matharena": "competition_olympiad_math",
    "mtbench": "open_ended_chat_creative_instruction",
}
PATTERNS = {
    "non_latin": r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{0900}-\x{097f}\x{0400}-\x{04ff}\x{0e00}-\x{0e7f}\x{0590}-\x{05ff}]",
    "translation": r"\b(translate|translation|in (?:chinese|spanish|french|german|japanese|korean|arabic|portuguese|italian|russian|hindi|swahili|yoruba|hausa)\b)",
    "nli": r"(?:^|\b)(premise\s*[:\-]|hypothesis\s*[:\-]|is the hypothesis entailed|it is not possible to tell|based on this premise|natural language inference|common[\s_-]?sense)",
    "safety": r"(jailbreak|prompt[\s_-]?injection|\[injection_task\]|\bdan\b(?:\s*mode)?|ignore (?:all )?(?:previous|prior) (?:instructions|prompts)|how (?:to|do i) (?:make|build|create|synthesize) (?:a )?(?:bomb|explosive|weapon|virus|malware|drug)|\bharmful\b|illegal\s+(?:drugs|activities|weapons|substance)|hide (?:illegal|the body|evidence)|\bhack(?:ing)?\s+(?:into|someone|password)|\bbypass\s+(?:safety|filters|moderation)|pretend (?:to be|you are) (?:able|allowed)|\brefuse\b|\brefusal\b|unsafe\s+(?:content|response)|\bracial\s+slur)",
    "code": r"(```[a-z+#-]*\n|\bdef\s+[a-zA-Z_][\w]*\s*\(|\bclass\s+[A-Z][\w]*\s*[:\(]|\bfunction\s+[a-zA-Z_][\w]*\s*\(|\bpublic\s+(?:static\s+)?[a-zA-Z_<>\[\]]+\s+[a-zA-Z_][\w]*\s*\(|\bvector<|std::|#include\s*<|<\s*html|<\s*body|<\s*div\b|<\s*script\b|<\s*style\b|\bSELECT\s+.+\s+FROM\b|input\s*-\s*output|sample\s+input|\bleetcode\b|atcoder|codeforces)",
    "html": r"(<\s*html|<\s*body|<\s*div\b|<\s*script\b|<\s*style\b|\.(?:css|html)\b|css\s+(?:rule|style)|html\s+page)",
    "math": r"(\\frac|\\sum|\\int|\\sqrt|\\mathbb|\\mathcal|\$\$|\\\(|\\\[|\bprove\s+that\b|\btheorem\b|\blemma\b|\bolympiad\b|\baime\b|\busamo\b|\bputnam\b|\bimo\b|\bimc\b|miklos|\bcompetition\s+math|\binequality\b|\bcombinator|\bpolynomial\b|\bdivisor|\bmodulo\b|\\angle|\\triangle|\bdihedral\b)",
    "visual": r"(\bimage\b|\bphoto\b|\bpicture\b|\bfigure\b|\bdiagram\b|\bchart\b|\bgraph\b|\babove (?:image|figure)\b|\bin the (?:image|figure|picture|photo)\b|food\s+web|\bsee the (?:image|figure))",
    "medical": r"(\bdiagnosis\b|\bdiagnose|\bsymptoms?\b|\bpatient\b|\bclinical\b|\btreatment\b|\bmedication\b|\bdrug\b\s+(?:dose|interaction|allergy)|\bhospital\b|\bphysician\b|\bnurse\b|\bsurgery\b|\bhealth\b|\bdisease\b|\bsyndrome\b|\bpneum|\bcardiac\b|\binfection\b|public\s+health|prescrib|antibiotic|vaccine|\bdose\b|\boncology\b|\bpediatric\b)",
    "mcq_math": r"\b(math|mathematics|algebra|geometry|calculus|probability|statistics|differential|integral|matrix|vector\s+space|eigen|topology|combinatoric|number\s+theory)\b",
    "mcq_medical": r"\b(medicine|medical|clinical|health|biomedical|physiology|anatomy|pharmac|pathology|epidemiology|nursing)\b",
    "mcq_stem": r"\b(physics|chemistry|chemical|biology|biological|engineer|engineering|computer\s+science|cs\b|algorithm|thermodynam|electromagn|quantum|molecule|reaction|cell|protein|gene|convect|circuit|cache|kernel|process|operating\s+system|set-associative)\b",
    "mcq_humanities": r"\b(history|philosoph|psycholog|sociolog|law\b|legal|business|management|economic|finance|accounting|literature|political|government|ethic|religion|theology|family\s+therapist|salvador\s+minuchin)\b",
}
CHAT, TRANSLATION, NLI, STEM, HUMANITIES, MEDICAL, MATH, _, VISUAL, FRONTIER, CODE, SOFTWARE, TOOLS, _, SAFETY = CATEGORIES
#: By benchmark: pairs of patterns, any of which gives the category, in order; last, what else.
ROUTES = {
    "hle": ([(["math", "mcq_math"], MATH)], FRONTIER),
    "agentdojo": ([(["safety"], SAFETY)], TOOLS),
    "rewardbench": ([(["safety"], SAFETY), (["code"], CODE), (["math"], MATH), (["medical"], MEDICAL)], CHAT),
    "mmlupro": ([(["mcq_math", "math"], MATH), (["mcq_medical", "medical"], MEDICAL), (["mcq_stem"], STEM), (["mcq_humanities"], HUMANITIES), (["nli"], NLI)], HUMANITIES),
    "ultrafeedback": ([(["safety"], SAFETY), (["non_latin", "translation"], TRANSLATION), (["nli"], NLI), (["html"], SOFTWARE), (["code"], CODE), (["math"], MATH)], CHAT),
    None: ([(["safety"], SAFETY), (["non_latin", "translation"], TRANSLATION), (["code", "html"], CODE), (["medical"], MEDICAL), (["math"], MATH), (["visual"], VISUAL)], CHAT),
}
WORD = r"\p{L}\p{N}_"


def portable(pattern: str) -> str:
    """The pattern for a test of presence, in a form that means the same to engines whose \\b and \\w differ."""
    edge = rf"(?:^|$|[^{WORD}])"
    out = pattern.replace(r"[\w]*", f"[{WORD}]*")
    # a boundary before a word consumes the character before it; after a word, the one after it
    return "(?is)" + out.replace(r"\b", edge)


def normalised(benchmark: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(benchmark, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def category(benchmark: Column, content: Column, item_id: Column) -> Column:
    """The slug. Empty content: the item's id is matched instead."""
    b = normalised(benchmark)
    text = F.coalesce(F.nullif(content, F.lit("")), item_id, F.lit(""))
    fits = {n: F.rlike(text, F.lit(portable(p))) for n, p in PATTERNS.items()}

    def by_patterns(route: tuple) -> Column:
        out = None
        for names, slug in route[0]:
            hit = fits[names[0]]
            for n in names[1:]:
                hit = hit | fits[n]
            out = F.when(hit, slug) if out is None else out.when(hit, slug)
        return out.otherwise(route[1])

    out = None
    for name, slug in DIRECT.items():
        out = F.when(b == name, slug) if out is None else out.when(b == name, slug)
    for name, route in ROUTES.items():
        if name:
            out = out.when(b == name, by_patterns(route))
    return out.otherwise(by_patterns(ROUTES[None]))


def category_id(slug: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, CATEGORIES)), slug) - 1).cast("int")


def sql(benchmark: str, text: str) -> str:
    """What category() says, in SQL; benchmark normalised already."""
    q = lambda p: portable(p).replace("'", "''")
    route = lambda r: "CASE " + " ".join(f"WHEN {' OR '.join(f"regexp_matches({text}, '{q(PATTERNS[n])}')" for n in names)} THEN '{s}'" for names, s in r[0]) + f" ELSE '{r[1]}' END"
    direct = " ".join(f"WHEN '{b}' THEN '{s}'" for b, s in DIRECT.items())
    return f"CASE {benchmark} {direct} {' '.join(f"WHEN '{b}' THEN {route(r)}" for b, r in ROUTES.items() if b)} ELSE {route(ROUTES[None])} END"

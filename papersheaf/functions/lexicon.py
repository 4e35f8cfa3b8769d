"""Word lists used for naming clusters."""

from __future__ import annotations

# fmt: off
# Words ignored when counting the words of a cluster.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as",
    "is", "was", "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "this", "that", "these", "those", "i", "you", "he",
    "she", "it", "we", "they", "what", "which", "who", "when", "where", "why", "how", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "such", "only", "own", "same", "so", "than", "too", "very",
    "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further",
    "then", "once",
]

# Subject areas in order of precedence for ties, each with its keywords. Keywords of
# fewer than four letters or with an underscore never match a counted word.
DOMAINS = {
    "Technology": [
        "software", "computer", "algorithm", "data", "digital", "technology", "system", "network",
        "programming", "code", "application", "development", "internet", "web", "database", "server", "cloud",
        "cybersecurity",
    ],
    "AI_Machine_Learning": [
        "machine", "learning", "artificial", "intelligence", "neural", "network", "deep", "model", "training",
        "prediction", "algorithm", "classification", "regression", "clustering", "nlp", "computer_vision",
    ],
    "Healthcare_Medical": [
        "health", "medical", "patient", "clinical", "treatment", "disease", "therapy", "diagnosis", "hospital",
        "doctor", "medicine", "pharmaceutical", "surgery", "healthcare", "wellness", "symptoms",
    ],
    "Finance_Business": [
        "financial", "business", "revenue", "profit", "investment", "market", "economy", "trading", "stock",
        "banking", "capital", "budget", "accounting", "fiscal", "sales", "commerce", "corporate", "expense",
    ],
    "Legal_Law": [
        "legal", "law", "contract", "agreement", "court", "attorney", "legislation", "regulation",
        "compliance", "liability", "rights", "clause", "litigation", "judicial", "statute", "jurisdiction",
    ],
    "Education_Research": [
        "education", "research", "study", "academic", "university", "student", "learning", "teaching",
        "curriculum", "methodology", "analysis", "investigation", "experiment", "hypothesis", "thesis",
        "scholarly",
    ],
    "Science": [
        "science", "scientific", "experiment", "laboratory", "research", "hypothesis", "theory", "analysis",
        "biology", "chemistry", "physics", "engineering",
    ],
    "Marketing_Sales": [
        "marketing", "sales", "advertising", "campaign", "brand", "customer", "promotion", "consumer",
        "market", "strategy", "engagement",
    ],
    "Government_Policy": [
        "government", "policy", "public", "administration", "regulatory", "legislation", "political",
        "federal", "state", "municipal",
    ],
    "Environment": [
        "environment", "climate", "sustainability", "ecological", "conservation", "renewable", "pollution",
        "carbon", "green", "energy",
    ],
    "Agriculture": [
        "agriculture", "farming", "crop", "harvest", "cultivation", "livestock", "soil", "irrigation",
        "agricultural", "rural", "farm",
    ],
    "Arts_Culture": [
        "art", "music", "culture", "creative", "design", "artistic", "performance", "exhibition", "gallery",
        "theater", "entertainment",
    ],
    "Sports_Fitness": [
        "sport", "fitness", "athletic", "training", "exercise", "physical", "competition", "team", "game",
        "championship",
    ],
    "Real_Estate": [
        "property", "real_estate", "housing", "residential", "commercial", "building", "construction",
        "architecture", "lease", "rental",
    ],
}
# fmt: on

# Words ignored in file names.
FILENAME_STOP_WORDS = ["the", "and", "for", "with", "pdf", "doc"]

# Words ignored for themes, and the themes tried in order.
THEME_STOP_WORDS = ["that", "this", "with", "from", "they", "have", "been"]
THEMES = [
    ("AI_Machine_Learning", ["machine", "learning", "artificial"]),
    ("Legal_Documents", ["legal", "contract", "agreement"]),
    ("Financial_Reports", ["financial", "revenue", "profit"]),
    ("Healthcare_Research", ["clinical", "treatment", "patient"]),
]


def domain_rows(domains: dict[str, list[str]] | None = None) -> list[tuple[int, str, str]]:
    """``(domain_rank, domain, keyword)`` for each keyword of a lexicon."""
    rows = []
    for rank, (domain, keywords) in enumerate((domains or DOMAINS).items()):
        rows += [(rank, domain, keyword.lower()) for keyword in keywords]
    return rows

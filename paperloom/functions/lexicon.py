"""Fixed values that results depend on: word lists, headings, weights and thresholds."""

from __future__ import annotations

# Skills that are looked for.
SKILLS = [
    "python", "java", "c++", "c#", "javascript", "typescript", "html", "css", "sql",
    "react", "angular", "vue", "node.js", "fastapi", "django", "flask", "express",
    "next.js", "tailwind", "bootstrap",
    "machine learning", "deep learning", "nlp", "computer vision", "tensorflow",
    "pytorch", "scikit-learn", "pandas", "numpy", "opencv", "nltk", "spacy",
    "transformers", "huggingface", "llm", "rag", "q-learning", "cnn", "cnns", "lstm",
    "peft", "lora",
    "docker", "kubernetes", "aws", "azure", "gcp", "git", "github", "gitlab",
    "ci/cd", "postgresql", "mysql", "mongodb", "redis", "sqlite",
    "rest api", "graphql", "microservices", "agile", "scrum", "linux", "ubuntu", "posix",
]

# Headings of sections, in the order in which they are tried.
SECTIONS = {
    "summary": ["SUMMARY", "PROFESSIONAL SUMMARY", "PROFILE", "ABOUT ME", "OBJECTIVE", "CAREER OBJECTIVE", "CAREER SUMMARY", "PERSONAL SUMMARY"],
    "experience": ["EXPERIENCE", "WORK EXPERIENCE", "EMPLOYMENT HISTORY", "WORK HISTORY", "PROFESSIONAL EXPERIENCE"],
    "education": ["EDUCATION", "ACADEMIC BACKGROUND", "ACADEMIC QUALIFICATIONS", "EDUCATION AND TRAINING"],
    "skills": ["TECHNICAL SKILLS", "SKILLS", "CORE COMPETENCIES", "SKILLS & INTERESTS", "COMPETENCIES"],
    "projects": ["PROJECTS", "PERSONAL PROJECTS", "ACADEMIC PROJECTS", "KEY PROJECTS"],
    "certifications": ["CERTIFICATIONS", "LICENSES & CERTIFICATIONS", "CERTIFICATES", "COURSES & CERTIFICATIONS"],
    "community": ["COMMUNITY & VOLUNTEERING", "VOLUNTEERING", "COMMUNITY ENGAGEMENT", "EXTRA-CURRICULAR"],
}

# Verbs that open a line about an achievement.
ACTION_VERBS = [
    "achieved", "accelerated", "administered", "analyzed", "architected",
    "automated", "built", "created", "delivered", "designed", "developed",
    "directed", "drove", "engineered", "established", "executed", "expanded",
    "generated", "implemented", "improved", "increased", "initiated",
    "integrated", "launched", "led", "managed", "migrated", "optimized",
    "orchestrated", "organized", "overhauled", "pioneered", "produced",
    "reduced", "refactored", "resolved", "restructured", "scaled", "secured",
    "shipped", "spearheaded", "streamlined", "strengthened", "transformed",
    "upgraded", "authored", "deployed", "mentored", "negotiated",
]

# Words that tell a resume.
RESUME_WORDS = [
    "experience", "education", "skills", "projects", "summary", "work", "university", "certifications", "courses",
    "languages", "awards", "honors", "publications", "research", "interests", "hobbies", "references", "referees",
]

# Forms of the headings of the secondary sections, in the order in which they are tried.
_LEAD = r"(?:3\.{ws}*|•{ws}*)?"
HEADINGS = {
    "certifications": r"(?:certifications?|licenses?(?:{ws}*&{ws}*certifications?)?|credentials?|professional{ws}+certifications?|courses?{ws}*&{ws}*certifications?)",
    "languages": r"(?:languages?|languages?{ws}*spoken|spoken{ws}*languages?|language{ws}*proficiency)",
    "awards": r"(?:awards?|honors?|awards?{ws}*&{ws}*honors?|honors?{ws}*&{ws}*awards?|achievements?|academic{ws}+honors?)",
    "publications": r"(?:publications?|research{ws}+papers?|papers?|articles?|journals?|conference{ws}+proceedings?)",
    "interests": r"(?:interests?|hobbies?|personal{ws}+interests?|extracurricular{ws}+activities?|hobbies{ws}*&{ws}*interests?)",
    "references": r"(?:references?|professional{ws}+references?|referees?)",
    "summary": r"(?:summary|professional{ws}+summary|profile|about{ws}+me|objective|career{ws}+objective|career{ws}+summary)",
}
ANY_HEADING = r"(?:certifications?|licenses?|credentials?|languages?|awards?|honors?|achievements?|publications?|research{ws}+papers?|interests?|hobbies?|references?|referees?|experience|education|skills|projects|summary|work{ws}+experience)"
INLINE_SUMMARY = r"(?:summary|professional{ws}+summary|profile|about{ws}+me|objective|career{ws}+objective|career{ws}+summary|personal{ws}+summary)"

# What tells that a primary section is there.
PRIMARY = {
    "summary": ["summary", "objective", "profile", "about me"],
    "skills": ["skills", "technical skills", "competencies", "technologies"],
    "experience": ["experience", "work history", "employment"],
    "education": ["education", "academic background", "qualifications"],
    "projects": ["projects", "key projects", "academic projects"],
}

# Points of the categories, and where they are full.
MAXIMA = {"formatting": 15, "keywords": 25, "structure": 20, "achievements": 25, "ats_compatibility": 15}
BLOCK_POINTS, BULLET_POINTS, FULL_BLOCKS, FULL_BULLETS = 12.0, 8.0, 5, 0.30
LENGTH_POINTS, LONG_POINTS, LEAST_LENGTH, MOST_LENGTH, LONG_LINE, MOST_LONG = 8.0, 7.0, 20, 100, 200, 0.15
FULL_KEYWORDS = 15
METRIC_POINTS, VERB_POINTS, FULL_METRICS, FULL_VERBS = 15.0, 10.0, 0.30, 0.40
FULL_WORDS, SOME_WORDS, WORDS_A_PAGE = 100, 30, 50

# Limits of the gates.
EXTENSIONS = ["pdf", "docx", "txt"]
MOST_MB, CONTROL_SHARE = 10.0, 0.05
LEAST_WORDS, LEAST_AUDIT_WORDS = 15, 30

# Layout of pages.
SAME_COLUMN, LEAST_BLOCKS, LEAST_HEIGHT, LEAST_MIDDOTS = 25, 3, 0.25, 2

# Caps of a report's scores.
RED_FLAGS, RED_FLAG_ROWS, RED_CAP, FAILED_CAP = ["not found", "limited"], 3, (75, 50), (30, 5)

# Bounds of an explanation.
MOST_CATEGORIES, LONGEST_CATEGORY = 7, 60

# Names shown for labelled metrics.
METRIC_NAMES = {
    "bleu": "BLEU Score", "rouge": "ROUGE Score", "f1": "F1 Score", "f1score": "F1 Score", "map": "mAP", "iou": "IoU", "auc": "AUC", "rocauc": "ROC-AUC",
    "rmse": "RMSE", "mae": "MAE", "r2": "R² Score", "precision": "Precision", "recall": "Recall", "accuracy": "Accuracy %",
}

# Flags of the sections of a resume.
FLAGS = ["contact_info", "summary", "skills", "experience", "education", "projects", "certifications", "languages", "awards", "publications", "interests", "references"]

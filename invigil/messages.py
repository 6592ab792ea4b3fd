"""Error codes and texts a caller sees.  All of them are fixed values."""

# Codes and messages of rejected requests.
ERRORS: dict[str, str] = {
    "50001": "Instructor is not assigned to this course.",
    "50002": "Invalid question type.",
    "50010": "Invalid course assignment.",
    "50011": "Number of questions cannot be negative.",
    "50012": "Degree per question must be greater than zero.",
    "50013": "End time must be after start time.",
    "50014": "Total time must be greater than zero.",
    "50015": "At least one question is required.",
    "50016": "Exam total degree exceeds Course MaxDegree.",
    "50017": "Not enough MCQ questions in question pool.",
    "50018": "Not enough True/False questions in question pool.",
    "50019": "Not enough Text questions in question pool.",
    "50100": "Invalid course assignment.",
    "50101": "Exam degree exceeds Course MaxDegree.",
    "50102": "All selected questions must belong to the exam course.",
    "50200": "Exam not found.",
    "50201": "Student does not belong to exam Intake, Branch, or Track.",
    "50202": "Student exam EndTime must be after StartTime.",
    "50203": "Student exam schedule must be inside exam schedule.",
    "50300": "Student exam not found.",
    "50400": "Answer not found.",
    "50401": "Awarded degree is outside allowed range.",
    "50500": "Student exam not found.",
    "50501": "You can only answer during the scheduled exam time.",
    "50600": "Branch not found.",
}

# Messages of the cross-table rules.
RULES: dict[str, str] = {
    "I-1": "Student Track does not belong to Student Branch.",
    "I-2": "Exam Track does not belong to Exam Branch.",
    "I-3": "Student does not belong to the exam Intake, Branch, or Track.",
    "I-4": "Exam questions must belong to the same course as the exam.",
    "I-5": "Total exam question degrees cannot exceed Course MaxDegree.",
    "I-6": "Instructor can only create questions for an assigned course.",
    "I-7": "TFQuestion must reference a TF question.",
    "I-8": "TextQuestion must reference a Text question.",
    "I-9": "MCQChoice must reference an MCQ question.",
    "I-10a": "Student answer question is not part of the assigned exam.",
    "I-10b": "Selected MCQ choice does not belong to the question.",
    "I-10c": "Student answer fields do not match the question type.",
}

# Texts of our own for rules that have none above.
OWN: dict[str, str] = {
    "I-11": "A check constraint is violated.",
    "I-12": "A unique key is violated.",
    "I-13": "More than one choice of the question is marked correct.",
    "I-14": "A referenced row does not exist.",
    "I-15": "A required value is missing or a value is longer than its column.",
    "OVERFLOW": "The total does not fit the result column.",
}


def message(code: str) -> str:
    for texts in (ERRORS, RULES, OWN):
        if code in texts:
            return texts[code]
    raise KeyError(code)

"""Category code tables of the report dialog (number -> label)."""

REPORT_CATEGORIES = {1: "Harassment", 2: "Spam", 3: "Fraud", 4: "Graphic/Violent Content, Gore",
                     5: "Imminent Danger", 6: "Other"}
IMMINENT_DANGER_CATEGORIES = {1: "Credible threat of violence", 2: "Self-harm or suicidal intent",
                              3: "Doxxing"}
HARASSMENT_CATEGORIES = {1: "Organizing of Harassment", 2: "Misinformation/Impersonation",
                         3: "Hate Speech", 4: "Offensive content", 5: "Sexual Harassment",
                         6: "Doxxing", 7: "Spam"}

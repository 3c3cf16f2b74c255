"""Patterns and templates whose text decides the results."""

# White space as Python's str.split knows it, for Java and RE2 alike.
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
EMAIL_MASK = "|||EMAIL_ADDRESS|||"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = f"\\b{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}\\b"
IP_MASK = "|||IP_ADDRESS|||"
PHONE_BODY = (
    "(?i)(?<![0-9])(?:\\+?1[-.\\s]?)?(?:\\([0-9]{3}\\)[-.\\s]?|[0-9]{3}[-.\\s]?)[0-9]{3}[-.\\s]?[0-9]{4}"
    "(?:\\s?(?:ext|x|extension)\\.?\\s?[0-9]{2,5})?"
)
#: As stated the pattern ends in a look-behind and can't match; corrected it looks ahead.
PHONE = {"reference": PHONE_BODY + "(?<![0-9])", "corrected": PHONE_BODY + "(?![0-9])"}
PHONE_MASK = "|||PHONE_NUMBER|||"

#: White space as Unicode has it, which the pre-token patterns go by: without the four separators.
WHITE = SPACE.replace("\\x1c-\\x1f", "")
PRETOKEN = (
    f"'(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WHITE[1:-1]}\\p{{L}}\\p{{N}}]+|{WHITE}+(?![^{WHITE[1:-1]}])|{WHITE}+"
)
#: The simple form goes by all 29 characters that Python takes for white space.
PRETOKEN_SIMPLE = f"{SPACE}*[^{SPACE[1:-1]}]+"

SYSTEM_PROMPT = """# Instruction
Below is a list of conversations between a human and an AI assistant (you).
Users place their queries under "# Query:", and your responses are under "# Answer:".
You are a helpful, respectful, and honest assistant.
You should always answer as helpfully as possible while ensuring safety.
Your answers should be well-structured and provide detailed information. They should also have an engaging tone.
Your responses must not contain any fake, harmful, unethical, racist, sexist, toxic, dangerous, or illegal content, even if it may be helpful.
Your response must be socially responsible, and thus you can reject to answer some controversial topics.

# Query:
```{instruction}```

# Answer:
```"""
MMLU_PROMPT = """Answer the following multiple choice question about {subject}. Respond with a single sentence of the form "The correct answer is _", filling the blank with the letter corresponding to the correct answer (i.e., A, B, C or D).
Question: {question}
A. {a}
B. {b}
C. {c}
D. {d}
Answer:"""
#: The break before Answer is a backslash and an n, not a line end.
GSM8K_PROMPT = "{question}\\nAnswer:"
THINK_PROMPT = """A conversation between User and Assistant. The User asks a question, and the Assistant solves it. The Assistant first thinks about the reasoning process in the mind and then provides the User with the answer. The reasoning process is enclosed within <think> </think> and answer is enclosed within <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think> <answer> answer here </answer>.
User: {question}
Assistant: <think>"""
ANSWER_PROMPT = """You are a math assistant. Solve the user's question.
Give the final answer in LaTeX as \\\\boxed{...} on the last line.
User: {question}
Assistant:"""
STOPS = {"strict": ["</answer>"], "answer_focused": ["\nUser:", "</answer>"]}
ALPACA = """Below is an instruction that describes a task. Write a response that appropriately completes the request.

### Instruction:
{instruction}

### Response:
{response}"""
#: The indented form has twelve blanks before every line but the first.
ALPACA_INDENTED = ALPACA.replace("\n", "\n" + " " * 12).replace("\n" + " " * 12 + "\n", "\n\n")

TURN = "(?s)(Human|Assistant):\\s*(.*?)(?=(?:\\n\\n(?:Human|Assistant):)|\\z)"
NUMBER = "[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?"

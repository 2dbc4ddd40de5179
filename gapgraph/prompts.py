"""Prompts for extraction and hypotheses."""

EXTRACT_SYSTEM = "You read scientific prose and report the causal statements in it as JSON. You write nothing but JSON."

EXTRACT = """Report every cause-and-effect statement of the paragraph below.

Answer with one object {"claims": [...]}. Each claim has
- cause, effect: short noun phrases in lower case
- confidence: 0 to 1, how sure the text is that this is causal and not only a correlation:
  0.8 and above if it is stated as shown, 0.5 to 0.8 if it is supported, below 0.5 if it is a guess or an association
- mechanism: how, in a few words, or "mechanism not specified"
- evidence: the sentence that says so, word for word
If there is none, answer {"claims": []}.

Example paragraph: Smoke causes lung inflammation through oxidative stress.
Example answer: {"claims": [{"cause": "smoke", "effect": "lung inflammation", "confidence": 0.9, "mechanism": "oxidative stress", "evidence": "Smoke causes lung inflammation through oxidative stress."}]}
Example paragraph: The study was done in two towns.
Example answer: {"claims": []}

<paragraph>{paragraph}</paragraph>"""

HYPOTHESIS_SYSTEM = "You propose testable scientific hypotheses from gaps in a causal graph. You write nothing but JSON."

HYPOTHESIS = """A causal graph was built from {papers} papers. Known edges:
{context}

Variable: {variable}
Kind of gap: {kind}
Explanation: {explanation}
Neighbours: {neighbours}
Edges at the variable:
{existing}

The kind says where the graph is thin: MISSING_CAUSE and MISSING_EFFECT on one side of the variable,
ISOLATED_NODE on nearly all sides, LOW_CONFIDENCE_CHAIN in its evidence, BROKEN_CHAIN between two parts
of the literature. Fill that very place with one new edge, or with a measurement that would decide it.

Answer with one object that has hypothesis_text, predicted_cause, predicted_effect, predicted_mechanism,
testability_score (0 to 1), novelty_score (0 to 1), suggested_experiment and supporting_context."""

STRICT = "\n\nYour last answer could not be read. Write one valid JSON value and nothing else: no prose, no code fence."

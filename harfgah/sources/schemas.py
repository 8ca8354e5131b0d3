"""Schemas that are declared on every read, never inferred."""

EVALUATION = "id string, category string, input string, expected string, alternatives array<string>, notes string, expectAction string, faithful string, typedBy string, scene string, source string"
TRAINING = "latin string, labels array<string>, persian string, final boolean"
TYPED = "id string, persona string, worker string, fa array<string>, finglish array<string>"
NORMALIZATION = "group string, input string, output string, fold string"
LEXICAL = "en string, fa string, category string, claude string, luna string, claude_reason string, luna_reason string"
JUDGMENT = "key string, id string, refSpan string, hypSpan string, verdicts map<string,string>, accepted boolean, category string"
PARITY = "input string, ids array<int>, shape array<int>, logits array<float>, predicted string"
FREQUENCY = "word string, score double"
BIGRAM = "head string, tail string, score double"
VOWELS = "word string, vowels string"
EMISSIONS = "fa string, position string, unit string, p double"

"""Prompts of the generator and the evaluators, as templates over a scenario's columns.

They are defaults: any template with the same ``{names}`` does.
"""

from __future__ import annotations

GENERATION = """Write {conversation_type} text about {topic} that mixes two languages.
Main language: {first_language}.  Embedded language: {second_language}, about {cs_ratio} of the words.
Purpose of the switches: {cs_function}.  Where they occur: {cs_type}.
Tense: {tense}.  Perspective: {perspective}.
Speaker: {gender}, {age}, {education_level}.
Related article, if any: {article}
Results of tools, if any: {mcp_result}
Keep the grammar of both languages and the customs of their speakers.
Answer with JSON: {"instances": [sentence, ...]}"""

FLUENCY = """Judge the grammar of these {first_language}-{second_language} sentences: {data_generation_result}
Answer with JSON: {"fluency_score": 0 to 10, "errors": {sentence: error}, "summary": text}"""

NATURALNESS = """Would speakers of {first_language} and {second_language} say this? {data_generation_result}
Intended switches: {cs_type}, for {cs_function}.
Answer with JSON: {"naturalness_score": 0 to 10, "observations": {sentence: remark}, "summary": text}"""

CS_RATIO = """The words of these sentences were counted: {data_generation_result}
Counted: {computed_ratio}, so {actual_percent} are {second_language}.
Wanted: {target_second_percent} {second_language} and {target_first_percent} {first_language}.
Explain the difference.  Answer with JSON: {"ratio_score": 0 to 10, "computed_ratio": text, "notes": text}"""

SOCIAL_CULTURAL = """Do these sentences suit a speaker of {first_language} ({gender}, {age}, {education_level}) and the topic {topic}? {data_generation_result}
Answer with JSON: {"socio_cultural_score": 0 to 10, "issues": text, "summary": text}"""

REFINER = """Rewrite these sentences so that they answer the remarks: {data_generation_result}
Remarks: {summary}
Keep {cs_ratio} {second_language} in {first_language}.  Answer with JSON: {"instances": [sentence, ...]}"""

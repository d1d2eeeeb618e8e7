"""Operations on training text: scoring, extraction, tokenising, de-duplication, decontamination, sharding.

Nothing outside this subpackage imports it.
"""

"""Written by train_quality.py: the rules learned on the labelled documents, in order."""

RULES = (
    ('junk', (('more_sentence_rate', '<=', 0.0125791), ('digit_ratio', '<=', 0.0638526), ('common_share', '<=', 0.189212))),
    ('junk', (('sentence_rate', '<=', 0.000679348), ('symbol_ratio', '<=', 0.0572298), ('cell_line_share', '<=', 0.0714286), ('comma_word_share', '<=', 0.00462963))),
    ('junk', (('short_line_share', '<=', 0.00396825), ('distinct_pair_share', '<=', 0.306055))),
    ('table', (('cell_line_share', '>=', 0.723214), ('digit_ratio', '>=', 0.127302))),
    ('list', (('sentence_rate', '<=', 0.0191848), ('letter_word_share', '<=', 0.760545))),
    ('list', (('punct_line_share', '<=', 0.110324), ('symbol_ratio', '>=', 0.0588638))),
    ('list', (('short_line_share', '>=', 0.834091), ('mean_word_length', '<=', 5.76116))),
    ('list', (('more_sentence_rate', '<=', 0.00364964), ('mean_word_length', '>=', 4.98876))),
)

"""Declared schemas of the text formats; nothing is inferred."""

EDGES = "src string, dst string, weight string"
CLUSTERS = "word string, cid string, cluster string, isas string"
CLUSTERS_PROB = "word string, cid string, prob double, cluster string, isas string"
LABELLED = "word string, cid string, cluster string, isas string, coverage string"
INVENTORY = "sense string, prob string"
KEYWORD_INVENTORY = "word string, cid int, keyword string, cluster string"
RELATIONS = "hyponym string, hypernym string, freq double"
SPARSE = "word string, feature string, score string"
WSD_SET = "context_id string, target string, target_pos string, target_position string, gold_sense_ids string, predict_sense_ids string, golden_related string, predict_related string, context string"
WORD_PAIRS = "id int, word1 string, word2 string, score double, _empty string"
GOLD_PAIRS = "word1 string, word2 string, gold double"
CSV_PAIRS = "word1 string, word2 string"
CONTEXTS = "word string, context string"
VOCABULARY = "word string"
MFS_INVENTORY = "word string, cid string, cluster string"

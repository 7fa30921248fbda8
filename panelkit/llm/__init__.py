"""Training-data operators: mixing, scoring, filtering, de-duplication,
decontamination and packing of text corpora.  Nothing else in the library
imports this subpackage."""

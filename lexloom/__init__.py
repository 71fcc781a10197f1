"""lexloom: a DataFrame-native engine for document analytics and lexical retrieval."""

"""Public vocabulary namespaces and terms used when building graphs."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SKOSXL = "http://www.w3.org/2008/05/skos-xl#"
DCT = "http://purl.org/dc/terms/"
DC = "http://purl.org/dc/elements/1.1/"
DCAT = "http://www.w3.org/ns/dcat#"
FOAF = "http://xmlns.com/foaf/0.1/"
VCARD = "http://www.w3.org/2006/vcard/ns#"
VOID = "http://rdfs.org/ns/void#"
SCHEMA = "https://schema.org/"
QUDT = "http://qudt.org/schema/qudt/"
SOA = "https://semopenalex.org/ontology/"
SOA_BASE = "https://semopenalex.org/"
PRISM = "http://prismstandard.org/namespaces/basic/2.0/"
FABIO = "http://purl.org/spar/fabio/"
CITO = "http://purl.org/spar/cito/"
DBPEDIA_OWL = "https://dbpedia.org/ontology/"

RDF_TYPE = RDF + "type"
RDF_PROPERTY = RDF + "Property"
RDFS_LABEL = RDFS + "label"
RDFS_COMMENT = RDFS + "comment"
RDFS_SEE_ALSO = RDFS + "seeAlso"
PREF_LABEL = SKOS + "prefLabel"
ALT_LABEL = SKOS + "altLabel"
EXACT_MATCH = SKOS + "exactMatch"
CLOSE_MATCH = SKOS + "closeMatch"

# Suffixes that mark the two metadata graphs.
DCAT_GRAPH_SUFFIX = "/graph/dcat-metadata"
PUBLICATION_GRAPH_SUFFIX = "/graph/publication-reference"

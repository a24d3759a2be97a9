"""Lines written by hand for this test, apart from the generator that the field learns from: (text, spans as (kind, words))."""

LINES = [
    ("Please write to anna.kowalski@example.org before Friday.", [("email", "anna.kowalski@example.org")]),
    ("My address is bob [at] mailhost [dot] net, thanks!", [("email", "bob [at] mailhost [dot] net")]),
    ("You can reach sales at ourshop dot com for a quote", [("email", "sales at ourshop dot com")]),
    ("Contact: j.smith(at)firm.org", []),
    ("Send it to carla (at) verein (dot) org today", [("email", "carla (at) verein (dot) org")]),
    ("Call me on (415) 555-0132 after six.", [("phone", "(415) 555-0132")]),
    ("Tel: 030-555-0199", [("phone", "030-555-0199")]),
    ("phone 212.555.0147 or come by", [("phone", "212.555.0147")]),
    ("His mobile is +44 20 7946 0958, he said", [("phone", "+44 20 7946 0958")]),
    ("Fax +1 (202) 555-0181", [("phone", "+1 (202) 555-0181")]),
    ("For help ring 800-555-0100 at any hour", [("phone", "800-555-0100")]),
    ("The server 192.168.10.4 did not answer", [("ip", "192.168.10.4")]),
    ("Traffic from 8.8.4.4, mostly", [("ip", "8.8.4.4")]),
    ("host 10.0.0.256 is no address", []),
    ("Pay with 4111 1111 1111 1111 if you must", [("card", "4111 1111 1111 1111")]),
    ("card number 5500-0000-0000-0004.", [("card", "5500-0000-0000-0004")]),
    ("My Visa 4012.8888.8888.1881 expired", [("card", "4012.8888.8888.1881")]),
    ("order 4111 1111 1111 1112 was shipped", []),
    ("My name is Elena Petrova and I live here", [("name", "Elena Petrova")]),
    ("We met Dr. Okafor at noon", [("name", "Okafor")]),
    ("Mr. Tanaka wrote the report", [("name", "Tanaka")]),
    ("Name: Lucia Moreno", [("name", "Lucia Moreno")]),
    ("Mrs. Hall, please come in", [("name", "Hall")]),
    ("The name of the rose is a book", []),
    ("Chapter 3.4 covers version 2.1.0 of the tool", []),
    ("On 2021-04-12 the price fell to 1,204.50 dollars", []),
    ("She is at home and the dot is red", []),
    ("Room 555, floor 12, building 7", []),
    ("We look at net results, not at com stocks", []),
    ("The ratio is 16:9 and the score was 3-2", []),
    ("ISBN 978-3-16-148410-0 is out of print", []),
    ("Serial 00012 34567 and batch 998", []),
    ("Berlin is large. Paris is older.", []),
    ("the token = \"0123456789abcdef0123456789abcdef01234567\"", []),
    ("Nothing to see here, move along please", []),
    ("il numero di casa \u00e8 42, citofono Rossi", []),
    ("Bonjour, mon courriel: zoe.dupont@exemple.net et voil\u00e0", [("email", "zoe.dupont@exemple.net")]),
    ("Kontakt: Herr M\u00fcller, Telefon +49 (30) 5550142", [("phone", "+49 (30) 5550142")]),
    ("visa card 378282246310005 is on file", [("card", "378282246310005")]),
    ("Ping 172.16.254.1 and then 172.16.254.2!", [("ip", "172.16.254.1"), ("ip", "172.16.254.2")]),
]
